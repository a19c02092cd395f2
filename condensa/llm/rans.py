"""Token-id files coded with a static range asymmetric numeral system (rANS).

Method: one frequency table, counted over all ids and scaled to 2^SCALE_BITS, is shared by
all blocks. A block holds up to BLOCK_TOKENS ids of consecutive documents, coded by up to LANES
interleaved coders: lane j codes the ids j, j + LANES, ..., so that one step is a vector
operation over the lanes. States are 63-bit with 32-bit renormalisation. Every
CHECKPOINT_STEPS steps the block keeps the lanes' states and the place in its stream, from
which a reader can start; a checksum of the stream and one of the ids guard each block.

File format: a folder of Parquet files, one subfolder ``part=n`` for each run of document
ids, ascending, and in it one row per block, ascending. Parquet carries the blocks so that
any store that Spark reaches can hold them and lost tasks are redone by Spark's committer; they
are not compressed again. A block's columns:

    start         ids before the block in the whole data set
    n_tokens, lanes
    stream        32-bit words, in the order in which a decoder reads them
    steps, places, states   of the checkpoints; the first is the block's beginning
    stream_crc32, ids_crc32
    doc_ids, doc_starts, doc_sizes   the documents with ids inside the block: their first
                  position in the data set and all their ids

and ``table`` beside the blocks holds (id, frequency).

A null text is an empty one: its only id is the end id. A null document id sorts first.
Repeated ids and rows are kept; rows of equal ids go by a hash of the text. An
empty table gives no blocks and no rows. Documents longer than a block are cut into pieces
whose checksums are combined when read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from condensa.shipping import ship

from .common import partitions, scratch_path, stage
from .tokens import Vocabulary, library_words, worker_encoder

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
WORD_BITS = np.uint64(32)
LANES = 4096
CHECKPOINT_STEPS = 128
BLOCK_TOKENS = 1 << 21
END_ID = 0


class Table:
    """The shared frequencies: ``ids`` with ``freq`` that sum to 2^SCALE_BITS."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.uint32), freq.astype(np.uint64)
        self.upto = np.cumsum(self.freq) - self.freq
        self.place = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int32)
        self.place[ids] = np.arange(len(ids))
        self.slots = np.repeat(np.arange(len(ids), dtype=np.int32), freq)

    @staticmethod
    def scaled(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies of at least 1 that sum to 2^SCALE_BITS, the larger ones making up the difference."""
        total = 1 << SCALE_BITS
        if len(ids) > total // 2:
            raise ValueError(f"more than {total // 2} different ids")
        freq = np.maximum(1, np.floor(counts / counts.sum() * total)).astype(np.int64)
        excess = int(freq.sum()) - total
        by_size = np.argsort(-freq, kind="stable")
        if excess < 0:
            freq[by_size[0]] -= excess
        for i in by_size:
            if excess <= 0:
                break
            take = min(excess, int(freq[i]) // 2)
            freq[i] -= take
            excess -= take
        return ids, freq


def encode_block(ids: np.ndarray, table: Table) -> dict:
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    at = table.place[ids]
    freq, upto = table.freq[at], table.upto[at]
    limit = freq << np.uint64(31 - SCALE_BITS + 32)
    step = np.uint64(1 << SCALE_BITS) - freq  # (x // f << bits) + x % f + c = x + x // f * step + c
    state = np.full(lanes, LOW, np.uint64)
    words, count, marks = [], 0, []
    for t in range(-(-n // lanes) - 1, -1, -1):
        now = slice(t * lanes, min(n, (t + 1) * lanes))
        x = state[:now.stop - now.start]
        full = np.flatnonzero(x >= limit[now])
        if len(full):
            out = x[full]
            words.append(out.astype(np.uint32))  # the low word
            count += len(out)
            x[full] = out >> WORD_BITS
        q = x // freq[now]
        q *= step[now]
        x += q
        x += upto[now]
        if t % CHECKPOINT_STEPS == 0:
            marks.append((t, count, state.astype("<u8").tobytes()))
    stream = (np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)).astype("<u4").tobytes()
    marks.reverse()
    return {"n_tokens": n, "lanes": lanes, "stream": stream, "steps": [m[0] for m in marks], "places": [count - m[1] for m in marks],
            "states": b"".join(m[2] for m in marks), "stream_crc32": zlib.crc32(stream), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def decode_block(block: dict, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from checkpoint ``first`` up to checkpoint ``last`` (the end if None)."""
    n, lanes, steps = block["n_tokens"], block["lanes"], block["steps"]
    stream = np.frombuffer(block["stream"], "<u4").astype(np.uint64)
    state = np.frombuffer(block["states"], "<u8")[first * lanes:(first + 1) * lanes].astype(np.uint64)
    at = block["places"][first]
    begin = steps[first]
    end = -(-n // lanes) if last is None or last >= len(steps) else steps[last]
    out = np.empty(min(n, end * lanes) - begin * lanes, np.uint32)
    mask, shift = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    for t in range(begin, end):
        size = min(lanes, n - t * lanes)
        x = state[:size]
        slot = x & mask
        s = table.slots[slot]
        out[(t - begin) * lanes:(t - begin) * lanes + size] = table.ids[s]
        x = table.freq[s] * (x >> shift) + slot - table.upto[s]
        need = np.flatnonzero(x < LOW)
        x[need] = (x[need] << WORD_BITS) | stream[at:at + len(need)]
        at += len(need)
        state[:size] = x
    return out


_BLOCK = ("n_tokens bigint, lanes int, stream binary, steps array<int>, places array<bigint>, states binary, stream_crc32 bigint, ids_crc32 bigint")


def _schema(id_type: str) -> str:
    return f"part int, start bigint, {_BLOCK}, doc_ids array<{id_type}>, doc_starts array<bigint>, doc_sizes array<bigint>"


def tokenise_sorted(docs: DataFrame, vocab: Vocabulary, row_id: str, text: str, end_id: int) -> DataFrame:
    """part, place (ids before it in the part), doc_id, n_tokens, ids: ascending by (part, place).

    Range-partitioned by document id, so that the part numbers ascend with the ids. The last
    row of a part (place -1) holds the part's counts: its different ids and their numbers.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    rows = (docs.select(F.col(row_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
            .repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows_type = to_arrow_type(rows.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, place = worker_encoder(shared.value, "library", library_words, True), TaskContext.get().partitionId(), 0
        total = np.zeros(0, np.int64)
        for batch in batches:
            at = 0
            for ids, counts in encoder.batch(batch.column(1)):
                raw = np.insert(ids, np.cumsum(counts), end_id)  # 16 or 32 bits an id
                lens = counts + 1
                ends = np.cumsum(lens)
                each = [raw[e - n:e].tobytes() for e, n in zip(ends.tolist(), lens.tolist())]
                m = len(lens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * m, pa.int32()), pa.array(place + ends - lens, pa.int64()), batch.column(0).slice(at, m),
                     pa.array(lens, pa.int64()), pa.array(each, pa.binary())], names=["part", "place", "doc_id", "n_tokens", "ids"])
                at += m
                place += int(ends[-1])
                found = np.bincount(raw)
                total = np.concatenate([total, np.zeros(max(0, len(found) - len(total)), np.int64)])
                total[:len(found)] += found
        seen = np.flatnonzero(total)
        packed = seen.astype("<i8").tobytes() + total[seen].astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([-1], pa.int64()), pa.array([None], rows_type), pa.array([len(seen)], pa.int64()),
                                          pa.array([packed], pa.binary())], names=["part", "place", "doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(run, f"part int, place bigint, doc_id {kind}, n_tokens bigint, ids binary")


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def count_ids(tokenised: DataFrame) -> DataFrame:
    """id, n over all parts, from the counts that each part has left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                ids, counts = np.frombuffer(raw.as_py(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], names=["id", "n"])

    return tokenised.where("place < 0").select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, vocab: Vocabulary, path: str, row_id: str = "doc_id", text: str = "text", end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Tokenise ``docs`` and write the data set at ``path`` (see the module's text)."""
    spark = docs.sparkSession
    ship(spark)
    tokenised = stage(tokenise_sorted(docs, vocab, row_id, text, end_id), "rans-ids")
    # both results are bounded: by the vocabulary and by the number of parts
    counts = count_ids(tokenised).orderBy("id").toPandas()
    tokenised = tokenised.where("place >= 0")
    sizes = tokenised.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toPandas()
    bases = dict(zip(sizes["part"].tolist(), (sizes["n"].cumsum() - sizes["n"]).tolist()))
    ids, freq = Table.scaled(counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)) if len(counts) else (np.zeros(0, np.int64),) * 2
    spark.createDataFrame(pd.DataFrame({"id": ids, "frequency": freq}), "id bigint, frequency bigint").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((Table(ids, freq), bases))
    kind = tokenised.schema["doc_id"].dataType.simpleString()
    schema = _schema(kind)
    arrow = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = shared.value
        into = to_arrow_schema(arrow)
        part, held, pieces, n, begin = None, [], [], 0, 0

        def block() -> pa.RecordBatch:
            coded = encode_block(np.concatenate(held), table)
            row = {"part": part, "start": begin, **coded, "doc_ids": [p[0] for p in pieces], "doc_starts": [p[1] for p in pieces], "doc_sizes": [p[2] for p in pieces]}
            return pa.RecordBatch.from_pylist([row], schema=into)

        for batch in batches:
            for p, place, doc_id, size, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if n and p != part:
                    yield block()
                    held, pieces, n = [], [], 0
                part, start = p, base[p] + place
                ids, done = _ids(raw.as_py(), size), 0
                while done < size:  # a document may fill the rest of this block and more
                    if not n:
                        begin = start + done
                    take = min(size - done, block_tokens - n)
                    held.append(ids[done:done + take])
                    pieces.append((doc_id, start, size))
                    done, n = done + take, n + take
                    if n == block_tokens:
                        yield block()
                        held, pieces, n = [], [], 0
        if n:
            yield block()

    (tokenised.mapInArrow(run, schema).sortWithinPartitions("part", "start").write.partitionBy("part")
     .option("compression", "uncompressed").parquet(f"{path}/blocks"))


def read_pieces(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, size (of the document), place, n_tokens, crc32, ids of every piece of a
    document inside one block, decoded from the files; the blocks' checksums are verified."""
    ship(spark)
    blocks = spark.read.schema(_schema(id_type)).parquet(f"{path}/blocks")
    counted = spark.read.parquet(f"{path}/table").orderBy("id").toPandas()  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast(Table(counted["id"].to_numpy(np.int64), counted["frequency"].to_numpy(np.int64)))
    names = ["start", "n_tokens", "lanes", "stream", "steps", "places", "states", "stream_crc32", "ids_crc32", "doc_ids", "doc_starts", "doc_sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                if zlib.crc32(block["stream"]) != block["stream_crc32"]:
                    raise ValueError(f"the block at {block['start']} has a damaged stream")
                ids = decode_block(block, shared.value).astype("<u4")
                raw = ids.tobytes()
                if zlib.crc32(raw) != block["ids_crc32"]:
                    raise ValueError(f"the block at {block['start']} decodes to other ids")
                starts, sizes = np.array(block["doc_starts"], np.int64), np.array(block["doc_sizes"], np.int64)
                places = np.maximum(starts, block["start"])
                lens = np.minimum(starts + sizes, block["start"] + block["n_tokens"]) - places
                each = [raw[4 * a:4 * (a + n)] for a, n in zip((places - block["start"]).tolist(), lens.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(starts), pa.array(sizes), pa.array(places),
                     pa.array(lens), pa.array([zlib.crc32(e) for e in each], pa.int64()), pa.array(each, pa.binary())],
                    names=["doc_id", "start", "size", "place", "n_tokens", "crc32", "ids"])

    return blocks.select(*names).mapInArrow(run, f"doc_id {id_type}, start bigint, size bigint, place bigint, n_tokens bigint, crc32 bigint, ids binary")


def _times_x(power: int) -> int:
    """x^power modulo the CRC-32 polynomial, in its reflected form."""
    result, square = 1 << 31, 1 << 30
    while power:
        if power & 1:
            result = _product(result, square)
        square = _product(square, square)
        power >>= 1
    return result


def _product(a: int, b: int) -> int:
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def join_crc32(pieces: list[tuple[int, int]]) -> int:
    """CRC-32 of the joined pieces from (checksum, bytes) of each."""
    crc = pieces[0][0]
    for c, size in pieces[1:]:
        crc = _product(_times_x(8 * size), crc) ^ c
    return crc


def read_documents(spark: SparkSession, path: str, row_id: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """row_id, start, n_tokens, ids_crc32 of every document. The pieces of a document (a few
    numbers for each 2^21 ids) meet by its first position, where their checksums are joined."""
    @F.pandas_udf("bigint")
    def joined(pieces: pd.Series) -> pd.Series:
        return pieces.map(lambda found: join_crc32([(p["crc32"], 4 * p["n_tokens"]) for p in found]))

    pieces = read_pieces(spark, path, id_type).groupBy("doc_id", "start", "size").agg(F.sort_array(F.collect_list(F.struct("place", "n_tokens", "crc32"))).alias("pieces"))
    return pieces.select(F.col("doc_id").alias(row_id), "start", F.col("size").alias("n_tokens"), joined("pieces").alias("ids_crc32"))
