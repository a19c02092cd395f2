"""Removal of repeated byte strings by sorting a difference-cover sample of the suffixes.

A byte goes if it lies in a string of LENGTH bytes that also starts anywhere else, in the
same document or another one.

Method, after the difference-cover construction of suffix arrays, for prefixes of LENGTH bytes:

1. Sample. A difference cover picks suffixes so that any two equal strings have an aligned
   pair of sampled suffixes near their beginnings. Here the cover is chosen by content: of each
   WINDOW consecutive positions the one whose GRAM bytes have the least fingerprint
   (about 1 of 25 positions; the leftmost of equal ones). Equal strings pick the same.
2. Names and triples. A name is the fingerprint of 17 bytes; three names make the name of
   51 bytes, three of those the name of TRIPLE = 153 bytes, which every sampled suffix of
   a string of LENGTH bytes still has before its end. Sampled suffixes are sorted by it;
   those without an equal neighbour are done, and so are the strings that begin before them.
3. Recursion. The remaining sampled suffixes are sorted by the name of all bytes that the strings
   around them span. Equal ones are repeated throughout; one of each goes on for all.
4. Remaining suffixes. The strings that begin between sampled suffixes are merged in: each
   has its bytes up to the sample and the sample's continuation, in all LENGTH bytes,
   whose names are sorted; equal neighbours are repeated.

A full difference-cover sort with 2/3 of all positions as rows moves dozens of times the
input; the sample by content moves about a third of it. Names are 64-bit polynomial
fingerprints with a random table: computed where the text is, in constant time for any
length, so that a level of the recursion is one sort and no renaming round.

Work is packed: a row block (documents of about BLOCK_BYTES) sends its distinct names, cut
by value into column blocks; a column block sorts the names of all row blocks, compares
neighbours and reports to each row block which of its names others have, too. A name that
occurs many times in a row block is sent once, so common strings make no hot task.

A null text is an empty one. Texts of any length are scanned in pieces of SCAN_BYTES. Null
or repeated document ids are harmless: rows are never told apart by them. Equal texts are
strings that start elsewhere, like any others. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from condensa.shipping import ship

from .common import partitions, stage

LENGTH = 200
WINDOW = 48
GRAM = 24
TRIPLE = LENGTH - WINDOW + 1
SCAN_BYTES = 1 << 20
BLOCK_BYTES, BLOCK_ROWS = 12_000_000, 4096

#: Bytes of a name that travel: a chance match in the first sort only keeps a suffix a little longer.
FILTER_BYTES, NAME_BYTES = 5, 7

_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value of each byte, powers of the base and of its inverse, modulo 2^64."""
    n = SCAN_BYTES + LENGTH + 1
    table = np.random.default_rng(12).integers(0, 1 << 64, 256, dtype=np.uint64)

    def powers(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return table, powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Names:
    """Fingerprints of any substring of a piece of text."""

    def __init__(self, piece: np.ndarray):
        table, power, self.inverse = _powers()
        self.upto = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(table[piece] * power[:len(piece)], out=self.upto[1:])

    def raw(self, at: np.ndarray, size) -> np.ndarray:
        return (self.upto[at + size] - self.upto[at]) * self.inverse[at]

    def __call__(self, at: np.ndarray, size) -> np.ndarray:
        return mixed(self.raw(at, size))


def _least_in_windows(values: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each run of ``window`` consecutive values, by block-wise running minima from both sides."""
    n = len(values)
    padded = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - window + 1], ahead[window - 1:n])


def samples(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first start, last start, name) of the sampled suffixes of a text: the
    strings that begin at the starts have this as their sample."""
    found = []
    for c in range(0, len(text) - LENGTH + 1, SCAN_BYTES):
        piece = text[c:c + SCAN_BYTES + LENGTH - 1]
        starts = len(piece) - LENGTH + 1
        names = Names(piece)
        grams = starts + WINDOW - 1
        at = np.arange(grams, dtype=np.uint64)
        value = (names.upto[GRAM:GRAM + grams] - names.upto[:grams]) * names.inverse[:grams]
        least = _least_in_windows((value & np.uint64(0xFFFFFFFF00000000)) | at, WINDOW)
        pick = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(pick[1:] != pick[:-1]) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [starts]]) - 1
        x = pick[first]
        found.append((x + c, first + c, last + c, names(x, TRIPLE)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _names_of(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Names of text[at:at + size] for ascending positions, piece by piece."""
    out = np.empty(len(at), np.uint64)
    reach = SCAN_BYTES - 4 * LENGTH
    i = 0
    while i < len(at):
        begin = int(at[i])
        j = int(np.searchsorted(at, begin + reach, "left"))
        piece = text[begin:begin + SCAN_BYTES]
        out[i:j] = Names(piece)(at[i:j] - begin, size[i:j])
        i = j
    return out


_ROWS = ("column_block int, row_block bigint, kind int, names binary, flags binary, ids array<{id}>, lens binary, texts binary, places binary, "
         "removed array<array<struct<start:bigint,end:bigint>>>, sizes array<bigint>, digests array<string>")
TILE, REPORT, HOME, DONE = range(4)


def _packed(texts: list[bytes]) -> dict:
    """The texts of a row block as columns of its home row."""
    return {"lens": np.array([len(t) for t in texts], np.int64).tobytes(), "texts": pa.compress(b"".join(texts), codec="zstd", asbytes=True)}


def _unpacked(lens: bytes, texts: bytes) -> list[bytes]:
    sizes = np.frombuffer(lens, np.int64)
    raw = pa.decompress(texts, int(sizes.sum()), codec="zstd", asbytes=True)
    return [raw[e - n:e] for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist())]


class _Pass:
    """The steps of one sort by names, over row blocks and column blocks."""

    def __init__(self, id_type: str, blocks: int):
        self.ddl, self.blocks = _ROWS.format(id=id_type), blocks
        self.schema = to_arrow_schema(DataType.fromDDL(self.ddl))

    def row(self, row_block: int, kind: int, **more) -> dict:
        return {"column_block": row_block % self.blocks, "row_block": row_block, "kind": kind, **more}

    def cut(self, names: np.ndarray, width: int) -> np.ndarray:
        """Names as they travel: the column block is the remainder by the number of blocks, and ``width``
        bytes of the quotient go along. 7 bytes lose nothing from 256 blocks on, and 8 - log2(blocks) bits below."""
        n = np.uint64(self.blocks)
        return (names // n & np.uint64((1 << 8 * width) - 1)) * n + names % n

    def tiles(self, row_block: int, names: np.ndarray, width: int) -> Iterator[dict]:
        """Distinct sorted names, cut into column blocks."""
        block = (names % np.uint64(self.blocks)).astype(np.uint16 if self.blocks < 1 << 16 else np.int64)
        order = np.argsort(block, kind="stable")
        quotient = (names // np.uint64(self.blocks))[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        cuts = np.searchsorted(block[order], np.arange(self.blocks + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            yield {"column_block": b, "row_block": row_block, "kind": TILE, "names": quotient[cuts[b]:cuts[b + 1]].tobytes()}

    def table(self, rows: list[dict]) -> pa.Table:
        return pa.Table.from_pylist(rows, schema=self.schema)

    def compare(self, table: pa.Table, width: int) -> pa.Table:
        """Sort the names of a column block and report equal neighbours; flags mark the one
        row block that stands for all that have the name."""
        kind = np.asarray(table.column("kind"))
        out = [table.filter(pa.array(kind != TILE)).cast(self.schema)]
        tiles = table.filter(pa.array(kind == TILE))
        if tiles.num_rows:
            raw = [x.as_py() for x in tiles.column("names")]
            sizes = [len(x) // width for x in raw]
            names = _wide(b"".join(raw), width)
            order = np.argsort(names, kind="stable")
            new = np.concatenate([[True], names[order][1:] != names[order][:-1]])
            shared, first = np.empty(len(names), bool), np.empty(len(names), bool)
            shared[order] = ~(new & np.concatenate([new[1:], [True]]))
            first[order] = new
            rows, end = [], 0
            for block, row_block, n in zip(tiles.column("column_block").to_pylist(), tiles.column("row_block").to_pylist(), sizes):
                mine = slice(end, end + n)
                end += n
                some = shared[mine]
                if some.any():
                    rows.append({"column_block": block, "row_block": row_block, "kind": REPORT, "names": _narrow(names[mine][some], width), "flags": first[mine][some].tobytes()})
            if rows:
                out.append(self.table(rows))
        return pa.concat_tables(out)

    def reported(self, table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted names that other row blocks have, and whether this one stands for them."""
        n = np.uint64(self.blocks)
        found = [(b, x.as_py(), f.as_py()) for k, b, x, f in zip(table.column("kind").to_pylist(), table.column("column_block").to_pylist(), table.column("names"), table.column("flags"))
                 if k == REPORT]
        names = np.concatenate([_wide(x, width) * n + np.uint64(b) for b, x, _ in found] or [np.zeros(0, np.uint64)])
        first = np.concatenate([np.frombuffer(f, bool) for _, _, f in found] or [np.zeros(0, bool)])
        order = np.argsort(names)
        return names[order], first[order]


def _wide(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _narrow(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _member(names: np.ndarray, sorted_names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which names are among the sorted ones, and where."""
    if not len(sorted_names):
        return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
    at = np.minimum(np.searchsorted(sorted_names, names), len(sorted_names) - 1)
    return sorted_names[at] == names, at


def _repeated_here(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each name occurs more than once, and whether it is the first occurrence."""
    if not len(names):
        return np.zeros(0, bool), np.zeros(0, bool)
    _, first, group, count = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(names), bool)
    is_first[first] = True
    return count[group] > 1, is_first


def _finished(ids: list, texts: list[bytes], marks: list[np.ndarray]) -> dict:
    """Result columns of documents from the starts of their repeated strings (ascending)."""
    removed, digests = [], []
    for text, starts in zip(texts, marks):
        cut = np.flatnonzero(starts[1:] > starts[:-1] + LENGTH) + 1 if len(starts) else []
        runs = [(int(r[0]), int(r[-1]) + LENGTH) for r in np.split(starts, cut)] if len(starts) else []
        kept, at = hashlib.sha256(), 0
        view = memoryview(text)
        for a, b in runs:
            kept.update(view[at:a])
            at = b
        kept.update(view[at:])
        removed.append([{"start": a, "end": b} for a, b in runs])
        digests.append(kept.hexdigest())
    return {"ids": ids, "removed": removed, "sizes": [len(t) for t in texts], "digests": digests}


def _starts(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    lens = last - first + 1
    return np.repeat(first - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))


def repeats(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, n_bytes, removed (array of start, end in bytes), kept_sha256 of every row."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(row_id).alias("row_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    id_type = rows.schema["row_id"].dataType.simpleString()
    step = _Pass(id_type, partitions(spark))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list = []
        size = 0

        def block() -> Iterator[pa.RecordBatch]:
            row_block = (part << 32) + number
            names = np.concatenate([samples(np.frombuffer(t, np.uint8))[3] for _, t in held])
            tiles = step.tiles(row_block, np.unique(step.cut(names, FILTER_BYTES)), FILTER_BYTES)
            yield from step.table([step.row(row_block, HOME, ids=[i for i, _ in held], **_packed([t for _, t in held])), *tiles]).to_batches()

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((i, t.as_py()))
                size += len(held[-1][1])
                if size >= BLOCK_BYTES or len(held) >= BLOCK_ROWS:
                    yield from block()
                    held, size, number = [], 0, number + 1
        if held:
            yield from block()

    def home(table: pa.Table) -> tuple[int, list, list[bytes], bytes | None]:
        at = table.column("kind").to_pylist().index(HOME)
        return table.column("row_block")[at].as_py(), table.column("ids")[at].as_py(), _unpacked(table.column("lens")[at].as_py(), table.column("texts")[at].as_py()), table.column("places")[at].as_py()

    def after_triples(table: pa.Table) -> pa.Table:
        """Keep sampled suffixes whose triple occurs elsewhere; send the names of all that they span."""
        row_block, ids, texts, _ = home(table)
        known, _ = step.reported(table, FILTER_BYTES)
        found = [samples(np.frombuffer(t, np.uint8)) for t in texts]
        names = step.cut(np.concatenate([f[3] for f in found]), FILTER_BYTES)
        keep = _member(names, known)[0] | _repeated_here(names)[0]
        open_ids, open_texts, places, done = [], [], [], ([], [])
        ends = np.cumsum([len(f[3]) for f in found])
        for i, t, f, e in zip(ids, texts, found, ends.tolist()):
            mine = keep[e - len(f[3]):e]
            if mine.any():
                places.append(np.stack([np.full(int(mine.sum()), len(open_ids)), f[1][mine], f[2][mine]]))
                open_ids.append(i)
                open_texts.append(t)
            else:
                done[0].append(i)
                done[1].append(t)
        out = [step.row(row_block, DONE, **_finished(*done, [np.zeros(0, np.int64)] * len(done[0])))] if done[0] else []
        if open_ids:
            place = np.concatenate(places, axis=1)
            out.append(step.row(row_block, HOME, ids=open_ids, places=place.tobytes(), **_packed(open_texts)))
            out += step.tiles(row_block, np.unique(spans(open_texts, place)), NAME_BYTES)
        return step.table(out)

    def spans(texts: list[bytes], place: np.ndarray) -> np.ndarray:
        """Names of all bytes of the strings around each sampled suffix (and of how many strings)."""
        out = np.empty(place.shape[1], np.uint64)
        for i, t in enumerate(texts):
            a, z = np.searchsorted(place[0], [i, i + 1])
            first, last = place[1, a:z], place[2, a:z]
            out[a:z] = mixed(_names_of(np.frombuffer(t, np.uint8), first, last - first + LENGTH) + (last - first).astype(np.uint64))
        return step.cut(out, NAME_BYTES)

    def after_spans(table: pa.Table) -> pa.Table:
        """Equal spans are repeated; one of each and the rest send the names of their strings."""
        row_block, ids, texts, raw = home(table)
        place = np.frombuffer(raw, np.int64).reshape(3, -1)
        known, chosen = step.reported(table, NAME_BYTES)
        names = spans(texts, place)
        there, at = _member(names, known)
        here, first = _repeated_here(names)
        resolved = there | here
        stands = first & np.where(there, chosen[at] if len(chosen) else False, True)
        state = np.concatenate([place, [resolved.astype(np.int64), (stands | ~resolved).astype(np.int64)]])
        out = [step.row(row_block, HOME, ids=ids, places=state.tobytes(), **_packed(texts))]
        out += step.tiles(row_block, np.unique(np.concatenate([n for _, n, _ in strings(texts, state)])), NAME_BYTES)
        return step.table(out)

    def strings(texts: list[bytes], state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per document: starts of the strings sent, their names, starts that are repeated already."""
        for i, t in enumerate(texts):
            a, z = np.searchsorted(state[0], [i, i + 1])
            _, first, last, resolved, sent = state[:, a:z]
            start = _starts(first[sent == 1], last[sent == 1])
            names = _names_of(np.frombuffer(t, np.uint8), start, np.full(len(start), LENGTH))
            yield start, step.cut(names, NAME_BYTES), _starts(first[resolved == 1], last[resolved == 1])

    def after_strings(table: pa.Table) -> pa.Table:
        row_block, ids, texts, raw = home(table)
        state = np.frombuffer(raw, np.int64).reshape(5, -1)
        known, _ = step.reported(table, NAME_BYTES)
        found = list(strings(texts, state))
        names = np.concatenate([n for _, n, _ in found])
        repeated = _member(names, known)[0] | _repeated_here(names)[0]
        marks = []
        ends = np.cumsum([len(n) for _, n, _ in found])
        for (start, n, resolved), e in zip(found, ends.tolist()):
            marks.append(np.union1d(start[repeated[e - len(n):e]], resolved))
        return step.table([step.row(row_block, DONE, **_finished(ids, texts, marks))])

    def sort_by_names(tiled: DataFrame, after, width: int) -> DataFrame:
        return tiled.groupBy("column_block").applyInArrow(lambda table: step.compare(table, width), step.ddl).groupBy("row_block").applyInArrow(after, step.ddl)

    first = stage(sort_by_names(rows.mapInArrow(sample, step.ddl), after_triples, FILTER_BYTES), "repeats-triples")
    rest = sort_by_names(sort_by_names(first.where(F.col("kind") != DONE), after_spans, NAME_BYTES), after_strings, NAME_BYTES)
    done = first.where(F.col("kind") == DONE).union(rest)
    flat = done.select(F.explode(F.arrays_zip("ids", "sizes", "removed", "digests")).alias("d"))
    return flat.select(F.col("d.ids").alias(row_id), F.col("d.sizes").alias("n_bytes"), F.col("d.removed").alias("removed"), F.col("d.digests").alias("kept_sha256"))
