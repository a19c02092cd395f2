"""Byte-level BPE vocabularies and word-wise encoding of text batches inside tasks.

``read_vocabulary`` runs on the driver; its text (about 1.5 MB, bounded by the vocabulary) is broadcast,
so that executors need no tokenizer file. Within a Python worker ``WordEncoder`` splits
texts into pieces that start at pre-token boundaries, encodes each distinct piece once and gathers the ids; how a
list of distinct pieces is encoded is a parameter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
SPLIT = r"'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: Code points whose classes agree in the regex module and in the tokenizers library,
#: whatever their Unicode versions. A text with others is split by the library itself.
SAFE = ("\u0000-՗", "؀-ࡠ", "ऄ-ह", "‐-‧", "‰-⁞", "₠-₰", "←-⏰",
        "ぁ-ゖ", "ァ-ヺ", "一-龥", "가-힣", "\U0001f300-\U0001f5ff", "\U0001f600-\U0001f64f")
_UNSAFE = re.compile(f"[^{''.join(SAFE)}]")

#: Distinct pieces that a Python worker keeps, cut by spaces or by pre-tokens; beyond that it forgets the rare ones.
SPACE_WORDS, PRETOKEN_WORDS = 1_000_000, 300_000
#: Bytes of text that are split and gathered together (a longer text makes a run of its own),
#: by spaces in Arrow or by pre-tokens in Python.
SPACE_RUN_BYTES, PRETOKEN_RUN_BYTES = 12_000_000, 1_500_000


@dataclass(frozen=True)
class Vocabulary:
    """What the encoders need from a byte-level BPE file."""

    text: str

    @property
    def spec(self) -> dict:
        return _spec(self.text)


@lru_cache(maxsize=1)
def _spec(text: str) -> dict:
    spec = json.loads(text)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        raise ValueError("only plain byte-level BPE vocabularies are supported")
    if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that strip or match whole words only are not supported")
    return spec


def read_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file; truncation and padding settings are dropped."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["truncation"] = spec["padding"] = None
    text = json.dumps(spec, ensure_ascii=False)
    _spec(text)
    return Vocabulary(text)


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes
    stand for themselves, the others follow from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_bytes(token: str) -> bytes:
    letters = byte_letters()
    return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode("utf-8")


#: White space as the split pattern sees it.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Splitter:
    """Cuts texts into pre-tokens, or into larger pieces that can be encoded apart."""

    def __init__(self, vocab: Vocabulary, special: bool = True):
        """Without ``special`` the strings of added tokens are ordinary text."""
        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        self.find = regex.compile(SPLIT).findall
        self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        self.added = sorted((t["content"] for t in vocab.spec["added_tokens"] if special), key=len, reverse=True)
        self.at_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split if self.added else None

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or not _UNSAFE.search(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def pretokens(self, text: str) -> list[str]:
        """Their concatenation is the text; an added token is a pre-token of its own."""
        if not any(a in text for a in self.added):
            return self._plain(text)
        return [w for i, p in enumerate(self.at_added(text)) if p for w in ([p] if i % 2 else self._plain(p))]

    def apart(self) -> str:
        """RE2 pattern of what keeps a text from being cut before each space and line end: white
        space next to them, added tokens."""
        return f"[ \n][{_SPACES}]|[{_SPACES}]\n" + "".join("|" + re.escape(a) for a in self.added)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. starts[0]+lens[0]-1, starts[1] .. and so on."""
    ends = np.cumsum(lens, dtype=np.int64)
    if not len(ends):
        return ends
    kind = np.int32 if max(int(ends[-1]), int(starts.max()) + 1) < 1 << 31 else np.int64
    out = np.repeat((starts - (ends - lens)).astype(kind), lens)
    out += np.arange(ends[-1], dtype=kind)
    return out


#: Surely one pre-token: a space, if any, and Latin letters.
_ONE = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: A Latin letter or digit, then full stops or commas to the end.
_STOPPED = "[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f][.,]+$"


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class _Index(dict):
    """word -> number, new words numbered as they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class WordEncoder:
    """Ids of texts; each distinct piece is encoded once while the worker keeps it.

    A piece is a pre-token or, with ``coarse``, what lies between spaces (with the space before
    it): a pre-token begins at a space unless more white space follows, so such pieces
    can be encoded apart, and Arrow cuts and numbers them without a Python object each.
    """

    def __init__(self, vocab: Vocabulary, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], coarse: bool, special: bool = True,
                 max_words: int | None = None):
        self.splitter, self.encode_words, self.coarse = Splitter(vocab, special), encode_words, coarse
        self.max_words = max_words or (SPACE_WORDS if coarse else PRETOKEN_WORDS)
        self.run_bytes = SPACE_RUN_BYTES if coarse else PRETOKEN_RUN_BYTES
        spec = vocab.spec
        top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])], default=0)
        self.dtype = np.uint16 if top < 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.index, self.known = _Index(), 0
        self.flat, self.starts, self.lens, self.uses = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the words that came up more than once since the last time, at most half of all."""
        kept = np.flatnonzero(self.uses > 1)
        kept = kept[np.argsort(-self.uses[kept], kind="stable")[:self.max_words // 2]]
        words = list(self.index)
        self.index = _Index((words[i], n) for n, i in enumerate(kept.tolist()))
        self.flat, self.lens = self.flat[ragged(self.starts[kept], self.lens[kept])], self.lens[kept]
        self.starts, self.uses, self.known = np.cumsum(self.lens, dtype=np.int64) - self.lens, np.zeros(len(kept), np.int64), len(kept)

    def _learn(self) -> None:
        words = list(islice(self.index, self.known, None))
        if not words:
            return
        ids, lens = self.encode_words(words)
        starts = np.cumsum(lens) - lens + len(self.flat)
        self.flat = np.concatenate([self.flat, ids.astype(self.dtype)])
        self.starts, self.lens = np.concatenate([self.starts, starts]), np.concatenate([self.lens, lens.astype(np.int32)])
        self.known = len(self.index)

    def _numbers(self, words: Iterator[str], n: int) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int32, n)

    def _by_pretoken(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [self.splitter.pretokens(t) for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        return self._numbers(chain.from_iterable(words), int(counts.sum())), counts

    def _by_space(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words between spaces, and from a line end on; full stops and commas after a letter
        are words of their own (a pre-token begins there)."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        counts = np.diff(np.asarray(lists.offsets).astype(np.int64))
        coded = lists.flatten().dictionary_encode()
        code, words = np.asarray(coded.indices), coded.dictionary
        first = np.cumsum(counts) - counts  # no space before these
        marked = pc.match_substring_regex(words, _STOPPED)
        bare = pc.if_else(marked, pc.utf8_rtrim(words, ".,"), words)
        spaced = pc.if_else(pc.starts_with(words, "\n"), bare, pc.binary_join_element_wise(" ", bare, ""))
        body = self._numbers(_strings(spaced), len(words))
        tail = np.full(len(words), -1, np.int32)
        stopped = words.filter(marked)
        tail[np.asarray(marked)] = self._numbers((w[len(b):] for w, b in zip(_strings(stopped), _strings(bare.filter(marked)))), len(stopped))
        at, stops = body[code], tail[code]
        at[first] = self._numbers(_strings(bare.take(pa.array(code[first]))), len(first))
        size = 1 + (stops >= 0)
        ends = np.cumsum(size)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        out[ends - size] = at
        out[ends[stops >= 0] - 1] = stops[stops >= 0]
        upto = np.concatenate([[0], ends])
        return out, upto[first + counts] - upto[first]

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts, pieces per text."""
        if not self.coarse:
            return self._by_pretoken(texts.to_pylist())
        odd = np.asarray(pc.match_substring_regex(texts, self.splitter.apart()))
        if not odd.any():
            return self._by_space(texts)
        fine, fine_counts = self._by_pretoken(texts.filter(pa.array(odd)).to_pylist())
        if odd.all():
            return fine, fine_counts
        at, some = self._by_space(texts.filter(pa.array(~odd)))
        counts, starts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        counts[~odd], counts[odd] = some, fine_counts
        starts[~odd], starts[odd] = np.cumsum(some) - some, np.cumsum(fine_counts) - fine_counts + len(at)
        return np.concatenate([at, fine])[ragged(starts, counts)], counts

    def batch(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ids per text) for runs of texts, in order. The whole batch is split first,
        run by run, so that its new words are encoded together."""
        if len(self.index) > self.max_words:
            self._forget()
        upto = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
        numbered, begin = [], 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + self.run_bytes, "right")))
            numbered.append(self._pieces(texts.slice(begin, end - begin)))
            begin = end
        self._learn()
        self.uses = np.concatenate([self.uses, np.zeros(len(self.index) - len(self.uses), np.int64)])
        for at, pieces in numbered:
            self.uses += np.bincount(at, minlength=len(self.index))
            lens = self.lens[at]
            ids = self.flat[ragged(self.starts[at], lens)]
            total = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
            ends = np.cumsum(pieces)
            yield ids, total[ends] - total[ends - pieces]


_ENCODERS: dict = {}


def worker_encoder(vocab: Vocabulary, kind: str, make: Callable[..., Callable], coarse: bool, special: bool = True) -> WordEncoder:
    """The worker's own encoder: kept from task to task, one kind of one vocabulary at a time."""
    key = (kind, hash(vocab.text), special)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(vocab, make(vocab, special), coarse, special)
    return _ENCODERS[key]


def library_words(vocab: Vocabulary, special: bool = True) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encode distinct words with the tokenizers library: its model on each pre-token, in
    the letters that stand for bytes."""
    from tokenizers import Tokenizer

    tokenize = Tokenizer.from_str(vocab.text).model.tokenize
    added = {t["content"]: t["id"] for t in vocab.spec["added_tokens"] if special}
    letters = {b: c for c, b in byte_letters().items()}
    pretokens = Splitter(vocab, special).pretokens
    space = letters[ord(" ")]

    def slow(word: str) -> list[int]:
        return [added[word]] if word in added else [t.id for t in tokenize(word.encode().decode("latin-1").translate(letters))]

    def one(word: str) -> list[int]:
        if not _ONE.fullmatch(word):
            return [i for p in pretokens(word) for i in slow(p)]
        if word.isascii():
            return [t.id for t in tokenize(word.replace(" ", space))]
        return slow(word)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = list(map(one, words))
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens

    return encode
