"""Mixing sources to target weights with Efraimidis-Spirakis keys; DataFrame functions only.

A source's target is its share of all words, at most ``cap`` times its own
size. Whole epochs of every document come first; what is left of the target is
filled by a weighted sample without replacement: each document has an
exponential key ``-ln(u) / quality`` and those with the smallest keys are taken
until the words fill the rest.

Scale. Documents shrink to (doc_id, source, size, key) in one pass over the
texts. Sorting a source whole would put a third of the corpus in one task, so
keys are cut into ``BUCKETS`` buckets of about equal weight: sums by (source,
bucket), with map-side combine, say in which bucket a source's rest ends.
Buckets before it are taken whole, and only that one bucket is sorted. Targets
come from one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cipherlake.functions.storage import materialise

BUCKETS = 4096
#: Sources whose plan is broadcast at most, and the salts of the join beyond that.
BROADCAST_SOURCES, SALTS = 50_000, 32
WORD = r"[^\x20\x09-\x0D]+"
#: 2**52: u is the first 13 hex digits of a digest, over this.
UNIT = 4503599627370496.0


def quality_weight() -> Column:
    """Weight of a document from its columns size and chars: full for prose-like word lengths and 20 words or more, else half."""
    prose = (F.col("size") >= 20) & (F.col("chars") >= 3 * F.col("size")) & (F.col("chars") <= 12 * F.col("size"))
    return F.when(prose, F.lit(1.0)).otherwise(F.lit(0.5))


def targets(docs: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    With totals T and weights w, a source gets ``min(cap * size, level * w)``:
    sources are taken in the order of ``cap * size / w``, and the level is what
    those that are not capped share. Resharing the excess until none is above
    its cap ends in the same place.
    """
    sized = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    sized = sized.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    wide = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    sized = sized.withColumns({"k": F.row_number().over(by_ratio), "level": left / wide})
    # the level of the first source that stays below its cap holds for it and all after it
    free = F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct("k", "level"))
    sized = sized.withColumn("first", F.min(free).over(whole))
    capped = F.col("first").isNull() | (F.col("k") < F.col("first.k"))
    return sized.select("source", "source_size", F.round(F.when(capped, F.col("most")).otherwise(F.col("first.level") * F.col("w")), 6).alias("target"))


def _join_sources(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with their source's plan (key ``of``); no source's rows meet in one task.

    The plan has one row per source: it is broadcast where it is counted to be
    small, and repeated over ``SALTS`` salts of the rows where it is not.
    """
    if plan.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["of"]))
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("row_salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, rows["source"].eqNullSafe(salted["of"]) & (rows["row_salt"] == salted["salt"])).drop("salt", "row_salt")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, quality: Column | None = None, salt: str = "mix") -> DataFrame:
    """One row per row of ``docs (doc_id, text, source)``: doc_id, size, source_size, target, taken.

    ``size`` counts runs of characters other than space and \\t to \\r; a null
    text has 0. A null source is a source of its own and comes last. ``taken``
    is a multiple of ``size``, from 0 to ``cap`` times it. The document at the
    edge of a source's rest is taken if that ends nearer the target. Keys depend
    on doc_id alone: reruns agree, and ties (repeated rows) come in any order
    with the same result. A null doc_id has the key of the empty string.
    """
    sized = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    digest = F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(UNIT)
    key = -F.ln(u) / (quality_weight() if quality is None else quality)
    keyed = materialise(sized.withColumn("key", key).withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int")).select("doc_id", "source", "size", "bucket", "key"), "keyed")
    goal = materialise(targets(keyed, weights, cap), "targets")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", upto)
    edge = sums.join(goal, same(sums, goal)).where(F.col("before") + F.col("words") >= F.col("rest")).groupBy(sums["source"]).agg(F.min(F.struct("bucket", "before")).alias("edge"))
    plan = goal.join(edge, same(goal, edge), "left").select(goal["*"], F.col("edge.bucket").alias("edge_bucket"), F.col("edge.before").alias("edge_before"))
    met = _join_sources(keyed, materialise(plan.withColumnRenamed("source", "of"), "plan"))
    inside = F.col("edge_bucket").isNull() | (F.col("bucket") < F.col("edge_bucket"))
    sorted_ = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = met.withColumn("at_edge", F.coalesce(F.col("bucket") == F.col("edge_bucket"), F.lit(False)))
    edge_rows = rows.where("at_edge").withColumn("sum", F.col("edge_before") + F.coalesce(F.sum("size").over(sorted_), F.lit(0))).withColumn("more", 2 * F.col("sum") + F.col("size") <= 2 * F.col("rest")).drop("sum")
    out = rows.where("not at_edge").withColumn("more", inside).unionByName(edge_rows)
    taken = F.col("size") * (F.col("epochs") + F.col("more").cast("long"))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
