"""Helpers that the corpus operators share: tables and batches, folds, membership filters, blocks."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A-Z to a-z on UTF-8 bytes; other code points stay as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Bytes of rows that travel to Python in one batch, whatever the texts' lengths.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. Unless the session has a bound of its own, its Arrow batches are held to ``BATCH_BYTES`` from here on: 10,000 long texts would not fit."""
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def strings(column):
    """The strings of an Arrow column, a few at a time: a batch's texts are never all Python objects at once."""
    for i in range(0, len(column), 128):
        yield from column.slice(i, 128).to_pylist()


def parts(batches, rows: int = 500):
    """Arrow batches of at most ``rows`` rows, for what is large by row."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


#: Members, and their weight, of a block when members of a bucket are compared directly.
BLOCK, BLOCK_WEIGHT = 512, 1_000_000

#: Bits of a membership filter for each id, and at most; one 64-bit word to a row, so at most ``FILTER_BITS / 64`` rows are broadcast.
ID_BITS, FILTER_BITS = 16, 1 << 26


def possibly_in(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``df`` less most rows whose ``column`` is not in ``ids`` (one column of that name, no nulls, counted first).

    A hashed bitmap, sized by the count, is built by aggregation and broadcast, so
    wide rows that cannot match are not shuffled to the exact join that must
    follow. Of ids that need more than ``FILTER_BITS`` none is made and ``df`` comes
    back whole. However many there are, no row that matches is lost.
    """
    bits = 1 << max(12, (ID_BITS * ids.count()).bit_length())
    if bits > FILTER_BITS:
        return df
    bit = lambda: F.pmod(F.xxhash64(column), F.lit(bits))
    words = ids.select(bit().alias("h")).selectExpr("h div 64 AS __word", "shiftleft(1L, CAST(h % 64 AS INT)) AS b").groupBy("__word").agg(F.bit_or("b").alias("__bits"))
    marked = df.withColumn("__h", bit()).withColumn("__word", F.expr("__h div 64"))
    return marked.join(F.broadcast(words), "__word").where("bit_get(__bits, CAST(__h % 64 AS INT)) = 1").select(*df.columns)


def is_held_out(doc_id) -> bool:
    """Rows of the evaluation fold: crc32 of the id as text, modulo 5, is 0."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out(doc_id):
    """``is_held_out`` as a column."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def labelled_sample(spark, docs, labels, label, per_class, seed=11):
    """(doc_id, text, label) of at most ``per_class`` training rows of each label value.

    Rows come in the order of a hash of their id, so the sample does not depend
    on partitioning; ids are chosen on the narrow ``labels`` table, and at most
    ``2 * per_class`` of them are broadcast to fetch their texts. Rows of the
    evaluation fold, and rows with a null id or label, are never used. Rows that
    repeat an id count once, and an id labelled both ways is left out.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most").drop("most")
    picked = None
    for value in (0, 1):
        part = usable.where(F.col("label") == value).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = picked.collect()
    if not rows:
        return docs.select("doc_id", "text", F.lit(0).alias("label")).limit(0)
    # as Arrow: from a list of rows Spark would start Python workers of another kind, which idle beside the others
    ids = spark.createDataFrame(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "label": pa.array([r[1] for r in rows], pa.int32())}))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def open_blocks(met: DataFrame, comp: DataFrame, items: DataFrame) -> DataFrame:
    """Blocks of members that must be compared directly: rows (bucket, i, j, comp) and the columns of ``items``.

    ``met (bucket, id)`` are the buckets, each compared with one leader already,
    ``comp (node, component)`` what came of it, ``items (id, weight, ...)`` what a
    comparison needs. Buckets come in whose members are in several components.

    Members of a bucket's largest component need no comparison with each other,
    so only blocks with others meet every block. Buckets with the same members
    are taken once. A block holds about ``BLOCK`` members or
    ``BLOCK_WEIGHT`` of weight at most, by hash, so no group grows with the corpus.
    """
    placed = met.join(comp.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("comp"))
    sized = placed.join(items.groupBy("id").agg(F.max("weight").alias("weight")), "id")
    parts = sized.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.sum("weight").alias("e"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"))
    whole = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("mark").alias("mark"), F.count("*").alias("comps"), F.max(F.struct("n", "e", "comp")).alias("top"))
    # with a leader and one other component, or two members, every pair across components has been compared
    open_ = whole.where("n > 2 and comps > 1").groupBy("n", "e", "mark").agg(F.min(F.struct("bucket", "top")).alias("b")).select("b.bucket", F.col("b.top").alias("top"), "n", "e")
    blocks = lambda n, e: F.greatest(F.ceil(n / BLOCK), F.ceil(e / BLOCK_WEIGHT)).cast("int")
    open_ = open_.select("bucket", F.col("top.comp").alias("main"), blocks(F.col("top.n"), F.col("top.e")).alias("n_in"), blocks(F.col("n") - F.col("top.n"), F.col("e") - F.col("top.e")).alias("n_out"))
    rows = placed.join(open_, "bucket").withColumn("inner", F.col("comp") == F.col("main"))
    rows = rows.withColumn("own", F.when(F.col("inner"), F.col("n_out") + F.pmod(F.xxhash64("id"), F.col("n_in"))).otherwise(F.pmod(F.xxhash64("id"), F.col("n_out"))).cast("int"))
    # blocks 0 .. n_out-1 hold the others; a pair (i, j) has i among them
    last = F.when(F.col("inner"), F.col("n_out")).otherwise(F.col("n_out") + F.col("n_in"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (last - 1).cast("int"))))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "comp")
    return rows.join(items, "id")
