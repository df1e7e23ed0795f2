"""Repeated passages by overlapping three-line windows.

A line is what newlines part, and no longer than ``WRAP`` words: longer ones are
wrapped, so a passage that stands in one or two long lines has windows like
any other. Every run of three consecutive lines is hashed to 128 bits. A window
that occurs more than once anywhere in the corpus keeps its first occurrence, by
(doc_id, text hash, line); the lines under every later one are covered (where it
overlaps the first, those after it), and a document loses the union of its
covered lines.

Scale: one aggregation with map-side combine finds each window's first
occurrence and whether it repeats, so a frequent window is a counter and not a
group; the join back is one that adaptive execution can split. Only lines'
hashes are shuffled, and the texts once, to meet their covered lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cipherlake.functions.storage import materialise

WINDOW, WRAP = 3, 25
#: A line: up to ``WRAP`` words with the blanks around them and the newline, or blanks alone.
LINE = rf"(?:[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D]+){{1,{WRAP}}}[\x20\x09\x0B-\x0D]*\n?|[\x20\x09\x0B-\x0D]*\n|[\x20\x09\x0B-\x0D]+"


def lines_of(text: Column) -> Column:
    """The lines of a text with what ends them; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def _occurrences(docs: DataFrame) -> DataFrame:
    def line(x):
        x = F.rtrim(x, F.lit(" \t\n\x0b\x0c\r"))
        return F.struct(F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b"), (x == "").alias("blank"))

    hashed = docs.select("doc_id", F.xxhash64("text").alias("th"), F.transform(lines_of(F.col("text")), line).alias("hs"))

    def window(i):
        three = [F.get("hs", i + k) for k in range(WINDOW)]
        return F.struct(i.alias("pos"), F.xxhash64(F.lit(3), *[x["a"] for x in three]).alias("h1"), F.xxhash64(F.lit(4), *[x["b"] for x in three]).alias("h2"), (~(three[0]["blank"] & three[1]["blank"] & three[2]["blank"])).alias("ok"))

    runs = F.when(F.size("hs") >= WINDOW, F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size("hs") - WINDOW, F.lit(0))), window), lambda w: w["ok"]))
    return hashed.select("doc_id", "th", F.explode(runs).alias("w")).select("doc_id", "th", "w.pos", "w.h1", "w.h2")


def covered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, covered): line numbers from 0 that repeat an earlier window, for documents that have any."""
    occ = materialise(_occurrences(docs.select("doc_id", "text").where("text is not null and doc_id is not null")), "windows")
    at = F.struct("doc_id", "th", "pos")
    first = occ.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("h1", "h2", "first")
    # where it overlaps the first occurrence, a later one covers only the lines after that
    same = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.th") == F.col("th"))
    start = F.when(same, F.greatest("pos", F.col("first.pos") + WINDOW)).otherwise(F.col("pos"))
    later = occ.join(first, ["h1", "h2"]).where(at > F.col("first")).select("doc_id", "th", start.alias("start"), (F.col("pos") + WINDOW - 1).alias("end")).distinct()
    lines = F.flatten(F.collect_list(F.sequence("start", "end")))
    return later.groupBy("doc_id", "th").agg(F.array_distinct(lines).alias("covered"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less its repeated passages, and new columns n_lines, n_removed, removed_all.

    Lines are compared without blanks at their end, and a window of blank lines
    never counts; what is left stays as it stood, with its newlines.
    ``removed_all``: lines went and no line with text is left. A null text stays
    null, it and an empty one have 0 lines. Rows with a null doc_id keep their
    text and are not compared. Repeated rows (same doc_id and text) are one
    document and fare alike. Columns of ``docs`` named as the new ones are
    replaced; all others stay.
    """
    covered = covered_lines(docs).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("covered").alias("__covered"))
    own = docs.drop("n_lines", "n_removed", "removed_all")
    met = own.join(covered, (own["doc_id"] == covered["__id"]) & (F.xxhash64(own["text"]) == covered["__th"]), "left")

    def cut(lines):
        rest = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__covered"))
        return F.struct(F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "").alias("left"), F.size(lines).alias("n"))

    # the lines are bound once, wherever the planner puts this
    met = met.withColumn("__cut", F.get(F.transform(F.array(lines_of(F.col("text"))), cut), F.lit(0)))
    left = F.when(F.col("__covered").isNull(), F.col("text")).otherwise(F.col("__cut.left"))
    met = met.withColumns({"__left": left, "n_lines": F.coalesce(F.col("__cut.n"), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("__covered"), F.lit(0)).cast("long")})
    met = met.withColumn("removed_all", F.col("__covered").isNotNull() & F.coalesce(F.col("__left").rlike(r"^\s*$"), F.lit(False)))
    return met.withColumn("text", F.col("__left")).select(*own.columns, "n_lines", "n_removed", "removed_all")
