"""Exact Jaccard self-join of word n-gram sets as a blocked sparse matrix product.

The matrix has a row for each document and a column for each n-gram (by a 64-bit hash). The
overlaps of all pairs are its product with its own transpose; it is computed in blocks, and
bounds that follow from the sizes alone discard most of it first. With threshold t, two
documents a and b can link only if

* each has at least t of its columns in common with some other row: |a & b| >= t * |a|;
* t * |a| <= |b| <= |a| / t;
* they share one of the first |a| - ceil(t * |a|) + 1 columns of a, in any fixed order of
  the columns (here: rare columns first, then by hash).

1. ``shared_columns``: row blocks send their distinct columns, cut into column blocks; a
   column block finds which columns occur in two rows or more and reports back. Rows below
   the first bound are done: most documents of a corpus. A column that many rows of a
   block share is sent once per block, so a common column costs one entry a block.
2. Rows with equal sets form a class; one of each stays.
3. Remaining rows are ordered by their least hash (likely partners meet), cut into blocks
   by size, and each block is multiplied with itself, which labels the components within it.
4. Column frequencies are counted anew. Rows are sent to other blocks that hold a row with which
   they share a prefix column and no component so far, and are multiplied with those blocks:
   first one row for each component and column, then, with the components that this gives,
   all that is left. A product gives pairs of labels; ``components`` joins these labels.

Memory: a task holds one row block, one column block (about COLUMN_ENTRIES entries; how many words
a byte of text makes is an estimate, and a column block takes one entry a row block at least)
or one block and a run of rows sent to it. Pairs are never emitted, only labels that join. The driver
holds what is broadcast: tables whose rows are counted first, and which stay below fixed bounds.

A null or blank text has no columns, and links with nothing. A text with fewer words than
n has one column, the whole sequence. Repeated rows link like any two. Rows are told apart
by position, so null or repeated ids are harmless: the component's id is the least id that
is not null. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.shipping import ship

from .common import SPACE_CLASS, arrow_batches, join_small, prefix_scan, stage
from .components import components

#: Bounds of a row block (rows, columns of all rows) and of a block of step 3.
BLOCK_ROWS, BLOCK_COLUMNS = 2048, 1_000_000
NEAR_ROWS, NEAR_COLUMNS = 512, 500_000
#: Rows (a row's id and its block) that are broadcast at most; some 10 MB on the driver.
BROADCAST_BLOCKS = 100_000
#: Entries of a column block, on average: their number is estimated from the bytes of all texts.
COLUMN_ENTRIES, BYTES_A_WORD = 1_000_000, 6
#: Rows sent to a block that one task multiplies with it, and columns of all those rows.
SENT_ROWS, SENT_COLUMNS = 4096, 1_000_000
#: Ordinal of a column that several rows of its block share.
MANY = 0xFFFF


def shingle_hashes(text: Column, n: int) -> Column:
    """Sorted distinct hashes of the word n-grams of a text, capitals A-Z lowered."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lowered, f"[{SPACE_CLASS}]+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
        return F.when(F.size(w) >= n, F.array_distinct(many)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(words), grams), 1)


def _binary(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _of(raw, kind: str) -> np.ndarray:
    return np.frombuffer(raw, kind)


def _low_bits(blocks: int) -> int:
    """Bits of a column's hash that travel within its block: 48, or fewer beyond 2^16 blocks."""
    return 64 - max(16, (blocks - 1).bit_length())


def _column_ids(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Column block in the upper bits, the hash's lower bits below (48 for up to 2^16 blocks). A column
    block's entries travel as those lower bits; two columns of one document pair meet by chance with
    a probability of about (size / 2^26)^2 / blocks."""
    block, low = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), _low_bits(blocks)
    return (block << np.uint64(low)) | (hashes & np.uint64((1 << low) - 1))


def _pack48(ids: np.ndarray, low: int) -> bytes:
    below = np.ascontiguousarray(ids & np.uint64((1 << low) - 1), "<u8")
    return below.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(raw: bytes, block: int, low: int) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() | np.uint64(block << low)


_TILE = "column_block int, row_block bigint, kind int, ordinals binary, columns binary, ids array<{id}>, sizes binary"


def shared_columns(sets: DataFrame, threshold: int, blocks: int) -> DataFrame:
    """uid, row_id, n, columns (sorted; null if the row is below the first bound).

    ``sets`` has row_id and hashes; ``blocks`` is the number of column blocks. kind 0 rows are tiles, kind 1 rows the columns that a row
    block knows to be shared by itself, kind 2 rows the block's ids and sizes.
    """
    low = _low_bits(blocks)
    id_type = sets.schema["row_id"].dataType.simpleString()
    tile_type = _TILE.format(id=id_type)
    arrow_type = pa.schema([("column_block", pa.int32()), ("row_block", pa.int64()), ("kind", pa.int32()), ("ordinals", pa.binary()), ("columns", pa.binary()),
                            ("ids", pa.list_(pa.string() if id_type == "string" else pa.int64())), ("sizes", pa.binary())])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            lists = batch.column(1)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            values = np.asarray(lists.values).view(np.uint64)
            begin = 0
            while begin < batch.num_rows:
                end = min(batch.num_rows, begin + BLOCK_ROWS)
                end = max(begin + 1, int(np.searchsorted(offsets[:end + 1], offsets[begin] + BLOCK_COLUMNS, "right")) - 1)
                row_block, number = (part << 32) + number, number + 1
                yield from block_tiles(row_block, batch.column(0).slice(begin, end - begin).to_pylist(), offsets[begin:end + 1] - offsets[begin], values[offsets[begin]:offsets[end]])
                begin = end

    def block_tiles(row_block: int, ids: list, offsets: np.ndarray, columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(offsets)
        ordinal = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
        columns = _column_ids(columns, blocks)
        order = np.argsort(columns, kind="stable")
        c, o = columns[order], ordinal[order]
        first = np.concatenate([[True], c[1:] != c[:-1]]) if len(c) else np.zeros(0, bool)
        lone = first & np.concatenate([first[1:], [True]]) if len(c) else first
        rows = [(row_block % blocks, row_block, 2, None, None, ids, _binary(sizes, "<u4"))]
        if not lone.all():
            rows.append((row_block % blocks, row_block, 1, _binary(o[~lone], "<u2"), _binary(c[~lone], "<u8"), None, None))
        c, o = c[first], np.where(lone, o, MANY)[first]
        cuts = np.searchsorted(c >> np.uint64(low), np.arange(blocks + 1))  # sorted by column: block by block
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            a, z = cuts[b], cuts[b + 1]
            by_row = np.argsort(o[a:z], kind="stable")  # ascending ordinals shrink well in the shuffle
            rows.append((b, row_block, 0, _binary(o[a:z][by_row], "<u2"), _pack48(c[a:z][by_row], low), None, None))
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i:i + 64]), arrow_type.types)], schema=arrow_type)

    def count(table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("kind"))
        kept = [table.filter(pa.array(kind != 0))]
        found = table.filter(pa.array(kind == 0))
        if found.num_rows:
            parts = [_unpack48(x.as_py(), b, low) for b, x in zip(found.column("column_block").to_pylist(), found.column("columns"))]
            columns = np.concatenate(parts)
            at = np.concatenate([_of(x.as_py(), "<u2") for x in found.column("ordinals")])
            order = np.argsort(columns, kind="stable")
            c = columns[order]
            new = np.concatenate([[True], c[1:] != c[:-1]])
            shared = np.empty(len(c), bool)
            shared[order] = ~(new & np.concatenate([new[1:], [True]]))
            shared &= at != MANY  # those are known to their row block
            ends = np.cumsum([len(p) for p in parts])
            rows = []
            for row_block, begin, end in zip(found.column("row_block").to_pylist(), ends - [len(p) for p in parts], ends):
                mask = shared[begin:end]
                if mask.any():
                    rows.append((0, row_block, 1, _binary(at[begin:end][mask], "<u2"), _binary(columns[begin:end][mask], "<u8"), None, None))
            if rows:
                kept.append(pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), arrow_type.types)], schema=arrow_type))
        return pa.concat_tables([k.cast(arrow_type) for k in kept])

    out_type = pa.schema([("uid", pa.int64()), ("row_id", arrow_type.field("ids").type.value_type), ("n", pa.int64()), ("columns", pa.binary())])

    def gather(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_pylist()
        head = kind.index(2)
        ids, sizes = table.column("ids")[head].as_py(), _of(table.column("sizes")[head].as_py(), "<u4").astype(np.int64)
        row_block = table.column("row_block")[head].as_py()
        found = [i for i, k in enumerate(kind) if k == 1]
        ordinal = np.concatenate([_of(table.column("ordinals")[i].as_py(), "<u2") for i in found] or [np.zeros(0, np.uint16)])
        columns = np.concatenate([_of(table.column("columns")[i].as_py(), "<u8") for i in found] or [np.zeros(0, np.uint64)])
        order = np.lexsort((columns, ordinal))
        ordinal, columns = ordinal[order], columns[order]
        have = np.bincount(ordinal, minlength=len(sizes))
        ends = np.cumsum(have)
        keep = (sizes > 0) & (100 * have >= threshold * sizes)
        sets = [_binary(columns[e - h:e], "<u8") if k else None for e, h, k in zip(ends.tolist(), have.tolist(), keep.tolist())]
        # a partition's blocks and a block's rows are numbered below 2^20 and 2^12
        uid = ((row_block >> 32) << 32) + ((row_block & 0xFFFFFFFF) << 12) + np.arange(len(sizes))
        return pa.Table.from_arrays([pa.array(uid, pa.int64()), pa.array(ids, out_type.types[1]), pa.array(sizes), pa.array(sets, pa.binary())], schema=out_type)

    tiled = sets.select("row_id", "hashes").mapInArrow(tiles, tile_type)
    counted = tiled.groupBy("column_block").applyInArrow(count, tile_type)
    return counted.groupBy("row_block").applyInArrow(gather, f"uid bigint, row_id {id_type}, n bigint, columns binary")


class _Rows:
    """Rows as concatenated columns with an inverted index."""

    def __init__(self, columns: list[bytes], sizes: list[int]):
        parts = [_of(c, "<u8") for c in columns]
        self.parts, self.n = parts, np.array(sizes, np.int64)
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.columns, self.row = flat[order], row[order]

    def linked(self, columns: np.ndarray, n: int, threshold: int) -> np.ndarray:
        """Rows that link with a row of ``columns`` and size ``n``: overlap counts are accumulated over
        the columns, then compared with the bound that the two sizes give."""
        lo, hi = np.searchsorted(self.columns, columns, "left"), np.searchsorted(self.columns, columns, "right")
        lens = hi - lo
        total = int(lens.sum())
        if not total:
            return np.zeros(0, np.int64)
        at = np.repeat(lo - (np.cumsum(lens) - lens), lens) + np.arange(total)
        both = np.bincount(self.row[at], minlength=len(self.n))
        fits = (100 * self.n >= threshold * n) & (100 * n >= threshold * self.n)
        return np.flatnonzero(fits & (100 * both >= threshold * (self.n + n - both)))


def _merge(label: np.ndarray, hits: np.ndarray, own: int) -> int:
    """Give the rows ``hits`` and all rows of their labels the least of these labels and ``own``, in place."""
    met = np.unique(label[hits])
    least = min(own, int(met[0])) if len(met) else own
    label[np.isin(label, met) | (label == own)] = least
    return least


def _near_blocks(reps: DataFrame, threshold: int) -> DataFrame:
    """rid, n, columns, block, label: rows in blocks of rows with neighbouring least hashes; each block
    is multiplied with itself, label is the least rid of the row's component within the block.

    Blocks are cut by size from the order of (least hash, rid): equal least hashes fill as many blocks
    as they need, and small tables do not make small blocks.
    """
    def multiply(table: pa.Table) -> pa.Table:
        label = np.array(table.column("rid").to_pylist(), np.int64)
        n = table.column("n").to_pylist()
        rows = _Rows([c.as_py() for c in table.column("columns")], n)
        for i in range(len(n)):
            if (label == label[0]).all():
                break
            _merge(label, rows.linked(rows.parts[i], n[i], threshold), int(label[i]))
        return table.append_column("label", pa.array(label, pa.int64()))

    # columns are sorted: the first 8 bytes (little-endian) are the least hash
    weight = F.greatest(F.col("n"), F.lit(NEAR_COLUMNS // NEAR_ROWS))
    order = prefix_scan(reps.select("rid", F.substring("columns", 1, 8).alias("key"), weight.alias("weight")), [F.col("key"), F.col("rid")], {"at": F.col("weight")}, "jaccard-order")
    block = order.select("rid", F.floor((F.col("at") - F.col("weight")) / NEAR_COLUMNS).alias("block"))
    # the planner goes by the compressed bytes of a staged table, so the rows are counted
    block = F.broadcast(block) if reps.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS else block.hint("merge")
    return (reps.join(block, "rid").select("rid", "n", "columns", "block").groupBy("block")
            .applyInArrow(multiply, "rid bigint, n bigint, columns binary, block bigint, label bigint"))


def near_labels(reps: DataFrame, threshold: int) -> DataFrame:
    """rid, label: the rows of ``reps`` (rid, n, columns), the least rid that links reach."""
    blocked = stage(_near_blocks(reps, threshold), "jaccard-blocks")
    entries = blocked.select("rid", "n", "block", F.explode(_unpacked(F.col("columns"))).alias("column"))
    # columns of one row only cannot link; they stay out of the prefixes
    freq = entries.groupBy("column").agg(F.count("*").alias("freq")).where("freq > 1")
    rare = entries.join(freq, "column").groupBy("rid", "n", "block").agg(F.sort_array(F.collect_list(F.struct("freq", "column"))).alias("kept"))
    # unshared columns come first in the order: they use up the prefix
    prefix = F.expr(f"n - cast(ceil({threshold} * n / 100) as bigint) + 1 - (n - size(kept))")
    own = stage(rare.withColumn("length", prefix).where("length > 0")
                .select("rid", "n", "block", F.expr("transform(slice(kept, 1, cast(length as int)), e -> e.column)").alias("prefix")), "jaccard-prefixes")

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        """The rows of a block (left) times the rows sent to it (right): pairs of labels that a link joins."""
        edges = set()
        if left.num_rows:
            first = np.array(left.column("label").to_pylist(), np.int64)
            label = first.copy()
            rows = _Rows([c.as_py() for c in left.column("columns")], left.column("n").to_pylist())
            now: dict[int, int] = {}  # labels of sent rows after the joins so far
            for own, n, raw in zip(right.column("label").to_pylist(), right.column("n").to_pylist(), right.column("columns")):
                held = now.get(own, own)
                if (label == held).all():
                    continue
                hits = rows.linked(_of(raw.as_py(), "<u8"), n, threshold)
                hits = hits[label[hits] != held]
                if len(hits):
                    edges.update((own, x) for x in np.unique(first[hits]).tolist())
                    joined = set(np.unique(label[hits]).tolist()) | {held}
                    least = _merge(label, hits, held)
                    now = {k: least if v in joined else v for k, v in now.items()} | {own: least}
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    def product(sent: DataFrame, labelled: DataFrame) -> DataFrame:
        """``sent``: block, rid, n: multiply the row with the block, some SENT_ROWS rows and SENT_COLUMNS columns at a time."""
        turns = sent.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / SENT_ROWS), F.ceil(F.sum("n") / SENT_COLUMNS)).cast("int").alias("turns"))
        to = sent.join(turns, "block").withColumn("turn", F.pmod(F.xxhash64("rid"), F.col("turns")).cast("int")).drop("turns", "n")
        to = to.join(labelled.select("rid", "label", "n", "columns"), "rid")
        to = to.select(*[F.col(c).alias(c) for c in to.columns])  # columns of its own for the cogroup
        held = labelled.join(turns, "block").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
        return held.groupBy("block", "turn").cogroup(to.groupBy("block", "turn")).applyInArrow(multiply, "a bigint, b bigint")

    labelled = blocked
    for last in (False, True):
        labels = labelled.select("rid", "label")
        counts = stage(labels.groupBy("label").agg(F.count("*").alias("rows")).where("rows > 1"), "jaccard-counts")
        marks = join_small(labels, counts, ["label"], F.col("rid"), "left").withColumn("rows", F.coalesce("rows", F.lit(1).cast("bigint")))
        postings = own.join(marks, "rid").select(F.explode("prefix").alias("column"), "rid", "n", "block", F.struct("rows", "label").alias("group"))
        if not last:  # one row for each component and column
            postings = postings.groupBy("column", "group").agg(F.min(F.struct("rid", "n", "block")).alias("one")).select("column", "group", "one.*")
        tops = postings.groupBy("column", "block").agg(F.max("group").alias("top"), F.min("n").alias("least"), F.max("n").alias("most"))
        if not last:  # to the largest component of the column
            tops = tops.groupBy("column").agg(F.max(F.struct("top", "block", "least", "most")).alias("hub")).select("column", "hub.*")
        sent = (postings.withColumnRenamed("block", "home").join(tops, "column")
                .where((F.col("group") < F.col("top")) & (F.col("home") != F.col("block")))
                .where((100 * F.col("most") >= threshold * F.col("n")) & (100 * F.col("n") >= threshold * F.col("least")))
                .select("block", "rid", "n").distinct())
        # labels meet as nodes: the components so far are contracted
        joined = components(stage(product(stage(sent, "jaccard-sent"), labelled).distinct(), "jaccard-edges"), "jaccard-labels")
        labelled = (join_small(labelled, joined.select(F.col("node").alias("label"), F.col("label").alias("least")), ["label"], F.col("rid"), "left")
                    .withColumn("label", F.coalesce("least", "label")).drop("least"))
    return labelled.select("rid", "label")


def _unpacked(raw: Column) -> Column:
    """array<bigint>: the hash of each 64-bit integer of a binary (eight bytes each)."""
    count = F.length(raw) / 8
    return F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: F.xxhash64(F.substring(raw, i * 8 + 1, F.lit(8))))


def link_groups(docs: DataFrame, row_id: str = "doc_id", text: str = "text", n: int = 5, threshold: int = 80) -> DataFrame:
    """row_id, n_shingles, component_id of every row; ``threshold`` in percent.

    uid and representative are extra columns: of the rows of a component the one with the
    least (id, uid) is its representative.
    """
    spark = docs.sparkSession
    ship(spark)
    sets = docs.select(F.col(row_id).alias("row_id"), shingle_hashes(F.col(text), n).alias("hashes"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-size // (BYTES_A_WORD * COLUMN_ENTRIES)))
    with arrow_batches(spark, BLOCK_ROWS):
        rows = stage(shared_columns(sets, threshold, blocks), "jaccard-rows")
    # rows whose columns are all shared may have equal partners; the others are classes of their own
    keyed = rows.withColumn("key", F.when(F.length("columns") == 8 * F.col("n"), F.md5("columns")).when(F.col("columns").isNotNull(), F.col("uid").cast("string")))
    near = keyed.where("key is not null")
    classes = stage(near.groupBy("n", "key").agg(F.min("uid").alias("rid"), F.min(F.struct(F.col("row_id").isNull().alias("last"), "row_id", "uid")).alias("least"),
                                                 F.first("columns").alias("columns")), "jaccard-classes")
    labels = near_labels(classes.select("rid", "n", "columns"), threshold)
    named = classes.select("rid", "n", "key", "least").join(labels, "rid")
    # most classes are components of their own; a component of very many classes is joined without gathering it
    more = named.groupBy("label").agg(F.count("*").alias("classes"), F.min("least").alias("component")).where("classes > 1").drop("classes")
    found = stage(join_small(named, stage(more, "jaccard-least"), ["label"], F.col("rid"), "left")
                  .select("n", "key", F.coalesce("component", "least").alias("component")), "jaccard-components")
    alone = keyed.where("key is null").select("row_id", "n", "uid", F.col("row_id").alias("component_id"), F.col("uid").alias("first"))
    joined = (join_small(keyed.where("key is not null").drop("columns"), found, ["n", "key"], F.col("uid"))
              .select("row_id", "n", "uid", F.col("component.row_id").alias("component_id"), F.col("component.uid").alias("first")))
    return alone.union(joined).select(F.col("row_id").alias(row_id), F.col("n").alias("n_shingles"), "component_id", "uid", (F.col("uid") == F.col("first")).alias("representative"))
