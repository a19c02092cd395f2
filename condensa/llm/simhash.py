"""SimHash near-duplicates by Golay-code fuzzy hashing.

Two texts link when their 64-bit fingerprints differ in at most two bits. A fingerprint is cut into
segments of 23, 23 and 18 bits. The binary Golay code of length 23 is perfect: any 23 bits lie within
distance 3 of one codeword. The keys of a segment are the indices of all codewords within distance 4 of
it: one, or six where the nearest is at distance 3. Two segments at distance 2 or less share a key, that
of the codeword next to a word halfway between them.

Two differing bits leave one of the three segments without an error (pigeonhole), and the others with
two at most. So linked fingerprints share one of

* the first segment and a Golay key of the second,
* the second segment and a Golay key of the first,
* the third segment and Golay keys of the first and the second.

Fingerprints are joined on these keys and verified by counting differing bits. Equal fingerprints are one
row before that. Buckets of up to BUCKET_ROWS fingerprints are compared within. Fingerprints of
larger buckets, and of those that a range partition cuts, are joined on their 65 neighbours, themselves included: two of them link exactly if they
have a neighbour in common, at most 65 fingerprints do, and all those link with each other, so
one link to the least of them each is enough.

A null or blank text has the fingerprint zero, which links like any other. Fewer words than a shingle
needs make one shingle. Repeated rows and null or repeated ids are harmless: rows are told apart by
position, a component's id is the least id that is not null. An empty table gives no rows;
extra columns are ignored. Texts are read whole, some BITS_AT_ONCE shingles at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensa.shipping import ship

from .common import join_small, partitions, stage
from .components import components, stars

#: Words of a shingle, seed of its hash, most differing bits of a link.
SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 2
BITS_AT_ONCE = 1 << 16
#: Fingerprints of a bucket that are compared with each other; larger buckets go by neighbours.
BUCKET_ROWS = 64
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """Signed 64-bit integer: a bit is set if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at the six separators
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    reach = min(SHINGLE_WORDS, len(words)) - 1
    starts, ends = starts[:len(starts) - reach].tolist(), ends[reach:].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), BITS_AT_ONCE):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[i:i + BITS_AT_ONCE], ends[i:i + BITS_AT_ONCE])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, fp (bigint) of every row."""
    ship(docs.sparkSession)
    id_type = docs.schema[row_id].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["row_id", "fp"])

    return docs.select(F.col(row_id).alias("row_id"), F.col(text).cast("string").alias("text")).mapInArrow(made, f"row_id {id_type}, fp bigint")


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words, as polynomials, by the generator."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GOLAY << (bit - 11), 0)
    return words


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By remainder: the error pattern of least weight, the number of codewords within distance 4 of a
    word (1 or 6), and what their indices (upper 12 bits) differ by from that of the nearest."""
    bits = [1 << i for i in range(23)]
    patterns = [0, *bits] + [a | b for a in bits for b in bits if a < b] + [a | b | c for a in bits for b in bits if a < b for c in bits if b < c]
    patterns = np.array(patterns, np.int64)
    error = np.zeros(1 << 11, np.int64)
    error[_remainder(patterns)] = patterns
    info = np.arange(1 << 12, dtype=np.int64) << 11
    code = info | _remainder(info)
    seven = code[np.bitwise_count(code) == 7]
    count = np.ones(1 << 11, np.int64)
    apart = np.zeros((1 << 11, 6), np.int64)
    for r, e in enumerate(error.tolist()):
        if e.bit_count() == 3:  # codewords of weight 7 that hold the three bits lead to those at distance 4
            near = seven[(seven & e) == e] >> 11
            count[r] = 1 + len(near)
            apart[r, 1:] = near
    return error, count, apart


def golay_keys(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the indices of the codewords within distance 4 of each 23-bit segment."""
    error, count, apart = golay_tables()
    r = _remainder(segments)
    index = (segments ^ error[r]) >> 11
    valid = np.arange(6)[None, :] < count[r][:, None]
    row = np.nonzero(valid)[0]
    return row, (index[:, None] ^ apart[r])[valid]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the keys of each fingerprint; the upper two bits of a key name its family."""
    raw = fp.view(np.uint64)
    a, b = (raw & np.uint64((1 << 23) - 1)).astype(np.int64), (raw >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.int64)
    c = (raw >> np.uint64(46)).astype(np.int64)
    (ra, ka), (rb, kb) = golay_keys(a), golay_keys(b)
    # every key of a with every key of b of the same row
    na, nb = np.bincount(ra, minlength=len(fp)), np.bincount(rb, minlength=len(fp))
    of_a = np.repeat(np.arange(len(ra)), nb[ra])
    first_b = np.cumsum(nb) - nb
    step = np.arange(len(of_a)) - np.repeat(np.cumsum(nb[ra]) - nb[ra], nb[ra])
    both_row = ra[of_a]
    both = ka[of_a] << 12 | kb[first_b[both_row] + step]
    rows = np.concatenate([rb, ra, both_row])
    return rows, np.concatenate([a[rb] << 12 | kb, 1 << 60 | b[ra] << 12 | ka, 2 << 60 | c[both_row] << 24 | both])


def links(distinct: DataFrame) -> DataFrame:
    """a, b: edges that join the fingerprints (fp, each once, a staged table) as their links do."""
    spark = distinct.sparkSession
    ship(spark)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0))
            for i in range(0, len(fp), 4096):
                row, key = keys(fp[i:i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i:i + 4096][row])], names=["key", "fp"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal keys: edges of a forest of verified links; a fingerprint of a larger bucket with itself (a = b)."""
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def edges(key: np.ndarray, fp: np.ndarray, begins: bool, ends: bool) -> pa.RecordBatch:
            a, b = [fp[:0]], [fp[:0]]
            size = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), [len(key)]]))
            far = size > BUCKET_ROWS
            far[:1] |= begins
            far[-1:] |= ends
            far = np.repeat(far, size)
            hot = np.unique(fp[far])
            key, fp = key[~far], fp[~far]
            for d in range(1, BUCKET_ROWS):
                same = np.flatnonzero(key[d:] == key[:-d])
                if not len(same):
                    break
                near = same[np.bitwise_count((fp[same + d] ^ fp[same]).view(np.uint64)) <= MAX_BITS]
                a.append(fp[near])
                b.append(fp[near + d])
            u, v = stars(np.concatenate(a), np.concatenate(b))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, hot]), pa.int64()), pa.array(np.concatenate([v, hot]), pa.int64())], names=["a", "b"])

        begins = True
        for batch in batches:
            key, fp = np.concatenate([key, np.asarray(batch.column(0))]), np.concatenate([fp, np.asarray(batch.column(1))])
            if len(key) and key[0] != key[-1]:
                cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
                yield edges(key[:cut], fp[:cut], begins, False)
                key, fp, begins = key[cut:], fp[cut:], False
            elif len(key) > 1 << 16:  # one large bucket: what is put out here goes by neighbours like the rest
                yield pa.RecordBatch.from_arrays([pa.array(fp[BUCKET_ROWS + 1:])] * 2, names=["a", "b"])
                key, fp = key[:BUCKET_ROWS + 1], fp[:BUCKET_ROWS + 1]
        if len(key):
            yield edges(key, fp, begins, True)

    pairs = distinct.mapInArrow(keyed, "key bigint, fp bigint")
    # a bucket may hold a third of all: its rows are dealt over ranges; a range's first and last bucket go by neighbours
    ranged = pairs.repartitionByRange(partitions(spark), "key", "fp").sortWithinPartitions("key", "fp")
    found = stage(ranged.mapInArrow(compared, "a bigint, b bigint"), "simhash-links")
    hot = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    near = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))
    met = hot.select("fp", F.explode(near).alias("near")).groupBy("near").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = met.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b").select("a", "b")
    return found.where("a <> b").union(star).distinct()


def link_groups(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, fp, fingerprint (16 lowercase hex digits), component_id of every row."""
    made = stage(fingerprints(docs, row_id, text), "simhash-fingerprints")
    classes = stage(made.groupBy("fp").agg(F.min("row_id").alias("least")), "simhash-classes")
    joined = components(stage(links(classes.select("fp")), "simhash-edges"), "simhash-components")
    named = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    # most fingerprints are components of their own
    found = stage(named.join(joined.select("label").distinct(), "label").groupBy("label").agg(F.min("least").alias("component_id")), "simhash-components")
    ids = named.join(found, "label", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    out = join_small(made, stage(ids, "simhash-ids"), ["fp"], F.monotonically_increasing_id())
    digits: Column = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(F.col("row_id").alias(row_id), "fp", digits.alias("fingerprint"), "component_id")
