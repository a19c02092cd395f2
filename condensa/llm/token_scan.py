"""Token counts of documents from flat, unindexed token files.

Method: the files hold the ids of document after document, with an end id after each and
no index. Blocks of a file are searched for end ids by vector comparison; each block
reports its number of ids and the places of its ends. A prefix scan over the blocks (sums of ids and ends, greatest end so far) stitches the
document that crosses a block boundary and numbers the documents.

The scan has two levels, runs of RUN_BLOCKS blocks and the blocks of a run, so that a file of any
number of blocks meets in no single task as more than a row per run.

``write`` makes such files from texts: one per partition, documents in the partition's order,
as Parquet rows of raw little-endian bytes (kind 0; Parquet is the carrier, so that any
store and Spark's committer will do) and the order of the document ids beside them (kind
1: which document is the n-th, not where it is). ``read_flat`` reads plain binary files
by byte ranges, as the same blocks.

Strings of special tokens inside texts are ordinary text here, so the end id marks ends only. A
null text is an empty one (0 tokens). Null or repeated ids are kept as they are. Ids after the last end
of a file are a document without an end (``ended`` false). Empty tables and empty files
give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from condensa.shipping import ship

from .common import stage
from .tokens import Vocabulary, library_words, worker_encoder

BLOCK_IDS = 1 << 20
RUN_BLOCKS = 1024
ORDER_ROWS = 4096


def write(docs: DataFrame, vocab: Vocabulary, path: str, end_id: int, row_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write file, kind, number, payload, ids: blocks (kind 0) and document ids (kind 1) of every file."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocab)
    rows = docs.select(F.col(row_id).alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = rows.schema["row_id"].dataType
    list_type = pa.list_(to_arrow_type(id_type))
    names = ["file", "kind", "number", "payload", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = worker_encoder(shared.value, "library", library_words, True, False), TaskContext.get().partitionId()
        held, size, block, done = [], 0, 0, 0

        def rows_of(kind: int, number: int, payload: bytes | None, ids: pa.Array | None) -> pa.RecordBatch:
            listed = pa.array([None], list_type) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([kind], pa.int32()), pa.array([number], pa.int64()),
                                               pa.array([payload], pa.binary()), listed], names=names)

        for batch in batches:
            for a in range(0, batch.num_rows, ORDER_ROWS):
                ids = batch.column(0).slice(a, ORDER_ROWS)
                yield rows_of(1, done, None, pa.concat_arrays([ids]))
                done += len(ids)
            for ids, counts in encoder.batch(batch.column(1)):
                held.append(np.insert(ids, np.cumsum(counts), end_id))
                size += len(held[-1])
                if size >= block_ids:
                    flat = np.concatenate(held)
                    whole = size // block_ids * block_ids
                    for b in range(0, whole, block_ids):
                        yield rows_of(0, block, flat[b:b + block_ids].tobytes(), None)
                        block += 1
                    held, size = [flat[whole:]], size - whole
        if size:
            yield rows_of(0, block, np.concatenate(held).tobytes(), None)

    (rows.mapInArrow(run, f"file int, kind int, number bigint, payload binary, ids array<{id_type.simpleString()}>")
     .write.option("compression", "zstd").parquet(path))


def read_flat(spark: SparkSession, path: str, id_bytes: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """file (its path), number, payload of the blocks of plain binary token files of any size: a block is a row
    of path and offset, dealt out over the tasks, which read just its bytes."""
    ship(spark)
    step = block_ids * id_bytes
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")  # contents are not read
    ranges = files.select("path", F.explode(F.expr(f"sequence(0L, (length - 1) div {step}L)")).alias("number"), "length")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, number, length in zip(*(c.to_pylist() for c in batch.columns)):
                part = read_range(name, number * step, min(step, length - number * step))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64()), pa.array([part], pa.binary())], names=["file", "number", "payload"])

    return ranges.repartition(tasks, "path", "number").mapInArrow(run, "file string, number bigint, payload binary")


def read_range(path: str, offset: int, size: int) -> bytes:
    """Bytes of a file as Spark names it, on any store that Arrow knows."""
    store, name = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        part = f.read_at(size, offset)
    if len(part) != size:
        raise OSError(f"{path} has changed: {len(part)} of {size} bytes at {offset}")
    return part


def scan(blocks: DataFrame, end_id: int, id_bytes: int) -> DataFrame:
    """file, doc_no (from 0), start, n_tokens, ended: every document of every file, from the
    blocks (file, number, payload)."""
    ship(blocks.sparkSession)
    file_type = blocks.schema["file"].dataType

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(raw.as_buffer(), f"<u{id_bytes}") for raw in batch.column(2)]
            ends = [np.flatnonzero(x == end_id) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array([len(e) for e in ends], pa.int64()),
                 pa.array([int(e[-1]) if len(e) else None for e in ends], pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                names=["file", "number", "n_ids", "n_ends", "last_end", "ends"])

    found = stage(blocks.select("file", "number", "payload")
                  .mapInArrow(search, f"file {file_type.simpleString()}, number bigint, n_ids bigint, n_ends bigint, last_end bigint, ends array<bigint>"), "scan-blocks")
    runs = found.withColumn("run", F.floor(F.col("number") / RUN_BLOCKS))
    before_run = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    in_run = Window.partitionBy("file", "run").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = (runs.groupBy("file", "run").agg(F.sum("n_ids").alias("i"), F.sum("n_ends").alias("e"))
            .select("file", "run", F.coalesce(F.sum("i").over(before_run), zero).alias("ids_to_run"), F.coalesce(F.sum("e").over(before_run), zero).alias("ends_to_run")))
    placed = (runs.join(sums, ["file", "run"])
              .withColumn("base", F.col("ids_to_run") + F.coalesce(F.sum("n_ids").over(in_run), zero))
              .withColumn("doc_base", F.col("ends_to_run") + F.coalesce(F.sum("n_ends").over(in_run), zero))
              .withColumn("end_at", F.col("base") + F.col("last_end")))
    tops = (placed.groupBy("file", "run").agg(F.max("end_at").alias("top"), F.max(F.col("base") + F.col("n_ids")).alias("upto"))
            .select("file", "run", F.max("top").over(before_run).alias("top_before")))
    # the position after the last end before the block: where its first document begins
    begun = placed.join(tops, ["file", "run"]).withColumn("begin", F.coalesce(F.greatest("top_before", F.max("end_at").over(in_run)), F.lit(-1).cast("long")) + 1)
    docs = F.transform("ends", lambda e, i: F.struct(F.when(i == 0, F.col("begin")).otherwise(F.col("base") + F.get(F.col("ends"), i - 1) + 1).alias("start"),
                                                     (F.col("base") + e).alias("end")))
    ended = (begun.where("n_ends > 0").select("file", "doc_base", F.posexplode(docs).alias("pos", "doc"))
             .select("file", (F.col("doc_base") + F.col("pos")).alias("doc_no"), "doc.start", (F.col("doc.end") - F.col("doc.start")).alias("n_tokens"), F.lit(True).alias("ended")))
    tails = (begun.groupBy("file").agg(F.sum("n_ends").alias("doc_no"), F.coalesce(F.max("end_at") + 1, zero).alias("start"), F.max(F.col("base") + F.col("n_ids")).alias("upto"))
             .where("upto > start").select("file", "doc_no", "start", (F.col("upto") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")))
    return ended.union(tails)


def with_ids(counts: DataFrame, order: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """``counts`` with the document ids: the n-th document of a file has the n-th id written for it."""
    listed = order.select("file", "number", F.posexplode("ids").alias("pos", row_id)).select("file", (F.col("number") + F.col("pos")).alias("doc_no"), row_id)
    return listed.join(counts, ["file", "doc_no"])
