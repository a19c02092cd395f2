"""BPE encoding by a pair occurrence index, and decoding.

Method: the distinct pre-tokens of a batch of a partition are laid out as one array of
symbols. An index maps each mergeable pair to all its positions in that array. The active
ranks are taken in ascending order from a heap; all positions of the rank's pair are
merged at once, and the pairs that this makes to the left and to the right are appended
to their own lists. Positions that have gone stale are dropped when their list is read.

Merging all positions of a rank at once equals the usual order (lowest rank first, then leftmost)
if no merge makes a pair of a lower rank, which is checked for the vocabulary; otherwise
each word merges its leftmost position only before the ranks are looked at again.

A null text is an empty one: no ids. Texts of any length are encoded whole. Repeated rows
are rows of their own; an empty table gives no rows; extra columns are ignored by
``encode``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.shipping import ship

from .tokens import Vocabulary, WordEncoder, ragged, token_bytes


#: Distinct pre-tokens that are merged together.
BATCH_WORDS = 150_000


class PairIndex:
    """The merges of a vocabulary as arrays, and the encoder over lists of distinct words."""

    def __init__(self, vocab: Vocabulary, special: bool = True):
        spec = vocab.spec
        ids: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"] if special}
        self.by_byte = np.zeros(256, np.int32)
        for token, i in ids.items():
            raw = token_bytes(token)
            if len(raw) == 1:
                self.by_byte[raw[0]] = i
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int32)
        self.right = np.array([ids[b] for _, b in merges], np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        self.width = max([*ids.values(), *self.added.values(), 255]) + 1
        keys = self.left.astype(np.int64) * self.width + self.right
        # of equal pairs the last one counts, as in a dictionary
        last = len(keys) - 1 - np.unique(keys[::-1], return_index=True)[1]
        self.keys, self.ranks = keys[last], last.astype(np.int64)
        first_use = np.full(self.width, len(keys), np.int64)
        np.minimum.at(first_use, np.concatenate([self.left, self.right]), np.concatenate([np.arange(len(keys))] * 2))
        last_made = np.full(self.width, -1, np.int64)
        np.maximum.at(last_made, self.made, np.arange(len(keys)))
        self.ordered = bool((last_made < first_use).all())

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 without a merge."""
        if not len(self.keys):
            return np.full(len(a), -1, np.int64)
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of pre-tokens, BATCH_WORDS at a time."""
        parts = [self._encode(words[a:a + BATCH_WORDS]) for a in range(0, max(1, len(words)), BATCH_WORDS)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [b"" if w in self.added else w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self.by_byte[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        alive = self._merge(symbol, word)
        lens = np.bincount(word[alive], minlength=len(raw))
        ids = symbol[alive]
        special = [i for i, w in enumerate(words) if w in self.added]
        if special:
            at = (np.cumsum(lens) - lens)[special]
            ids = np.insert(ids, at, [self.added[words[i]] for i in special])
            lens[special] = 1
        return ids, lens

    def _merge(self, symbol: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Merge in place; returns which positions still hold a symbol."""
        n = len(symbol)
        alive, merged = np.ones(n, bool), np.zeros(n, bool)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        if n:
            ends = np.flatnonzero(word[1:] != word[:-1])
            after[ends], before[ends + 1] = -1, -1
            after[-1] = -1
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def append(at: np.ndarray) -> None:
            rank = self.rank_of(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, piece in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if r in lists:
                    lists[r].append(piece)
                else:
                    lists[r] = [piece]
                    heapq.heappush(active, r)

        for a in range(0, n, 1 << 18):
            append(a + np.flatnonzero(after[a:a + (1 << 18)] >= 0).astype(np.int32))
        while active:
            r = heapq.heappop(active)
            pieces = lists.pop(r)
            at = pieces[0] if len(pieces) == 1 else np.concatenate(pieces)
            a, b, c = self.left[r], self.right[r], self.made[r]
            nxt = after[at]
            at = at[alive[at] & (symbol[at] == a) & (nxt >= 0) & (symbol[nxt] == b)]
            if not len(at):
                continue
            if a == b or not self.ordered:
                at = np.sort(at)
            if not self.ordered:
                first = np.unique(word[at], return_index=True)[1]
                rest = np.delete(at, first)
                at = at[first]
                if len(rest):
                    lists[r] = [rest]
                    heapq.heappush(active, r)
            elif a == b:  # in a run of equal symbols every second position merges
                start = np.concatenate([[True], after[at[:-1]] != at[1:]])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0]
            gone = after[at]
            follow = after[gone]
            symbol[at], alive[gone], after[at] = c, False, follow
            has = follow >= 0
            before[follow[has]] = at[has]
            merged[at] = True
            ahead = before[at]
            ahead = ahead[ahead >= 0]
            new = np.concatenate([ahead[~merged[ahead]], at[has]])
            merged[at] = False
            append(new)
        return alive


class Decoder:
    """ids -> bytes by one gather; special tokens are kept as their text."""

    def __init__(self, vocab: Vocabulary):
        spec = vocab.spec
        by_id = {i: token_bytes(t) for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode("utf-8") for t in spec["added_tokens"]}
        top = max(by_id) + 1
        parts = [by_id.get(i, b"") for i in range(top)]
        self.lens = np.fromiter(map(len, parts), np.int64, top)
        self.starts = np.cumsum(self.lens) - self.lens
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def __call__(self, ids: np.ndarray) -> str:
        lens = self.lens[ids]
        return self.bytes[ragged(self.starts[ids], lens)].tobytes().decode("utf-8", "replace")


def encode(docs: DataFrame, vocab: Vocabulary, row_id: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """row_id, ids (little-endian unsigned 32-bit integers), n_tokens, [decoded]: one row per row of ``docs``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    rows = docs.select(F.col(row_id).alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # built for the task and dropped with it: an idle Python worker holds no words
        encoder = WordEncoder(shared.value, PairIndex(shared.value), False)
        decoder = Decoder(shared.value) if decode else None
        for batch in batches:
            at = 0
            for ids, counts in encoder.batch(batch.column(1)):
                ends = np.cumsum(counts)
                each = [ids[e - n:e] for e, n in zip(ends.tolist(), counts.tolist())]
                columns = [batch.column(0).slice(at, len(counts)), pa.array([e.astype("<u4").tobytes() for e in each], pa.binary()), pa.array(counts, pa.int64())]
                if decode:
                    columns.append(pa.array([decoder(e) for e in each], pa.string()))
                at += len(counts)
                yield pa.RecordBatch.from_arrays(columns, names=["row_id", "ids", "n_tokens", "decoded"][:len(columns)])

    return rows.mapInArrow(run, f"row_id {kind}, ids binary, n_tokens bigint" + ", decoded string" * decode).withColumnRenamed("row_id", row_id)


def digests(docs: DataFrame, vocab: Vocabulary, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    done = encode(docs, vocab, row_id, text)
    return done.select(row_id, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
