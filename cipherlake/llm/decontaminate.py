"""Benchmark passages in documents: a prefix-filtered containment join over item-sized windows.

The records of the join are the benchmark's windows (``width`` consecutive words
of an item, or the whole of a shorter one) and the documents' runs of as many
words. For whole containment the necessary prefix of a record, its tokens
ordered by rarity, is its rarest token; rarity is counted over all documents.
A document's word that is some window's prefix token proposes the windows that
have it there, the token's place in the window bounds where it can begin and
the lengths bound what fits, and the whole run of words is then compared.

Scale: documents are never shuffled. The benchmark is the stated query set: it
goes to the executors in blocks of at most ``block_windows`` windows, each one
pass over the documents whose hits are written before the next block is read, so
the driver and a worker hold one block. The driver also holds the benchmark's
vocabulary, which is counted over all documents once.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cipherlake.functions.storage import materialise
from cipherlake.llm.common import strings

#: Bytes that part words: ASCII other than letters and digits; A-Z become a-z.
WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split() if text else []


def windows(tokens: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    width = min(width, len(tokens))
    return {tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)} if width else set()


def _blocks(benchmark: DataFrame, width: int, most: int):
    """The benchmark as dictionaries window -> item ids, of about ``most`` windows each."""
    block: dict[tuple[bytes, ...], set[str]] = {}
    for row in benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null").toLocalIterator():
        for w in windows(words(row[1]), width):
            block.setdefault(w, set()).add(row[0])
            if len(block) >= most:
                yield block
                block = {}
    if block:
        yield block


def token_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of ``vocabulary`` occurs in all documents."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in strings(batch.column(0)):
                total.update(filter(known.value.__contains__, words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["token", "n"])

    rows = docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r[0]): r[1] for r in rows}


def prefix_index(block: dict, counts: dict[bytes, int]) -> dict[bytes, dict[tuple[int, int], dict[tuple, list[str]]]]:
    """rarest token -> (its place, window length) -> window -> item ids."""
    index: dict = {}
    for window, items in block.items():
        place = min(range(len(window)), key=lambda i: (counts.get(window[i], 0), i))
        index.setdefault(window[place], {}).setdefault((place, len(window)), {})[window] = sorted(items)
    return index


def find(tokens: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Word spans (start, end) under occurring windows, and the items these are of."""
    spans, items = [], set()
    for i, token in enumerate(tokens):
        if token in index:
            for (place, length), known in index[token].items():
                start = i - place
                if start >= 0 and start + length <= len(tokens) and (of := known.get(tuple(tokens[start : start + length]))):
                    spans.append((start, start + length))
                    items.update(of)
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _indexes(docs: DataFrame, benchmark: DataFrame, width: int, block_windows: int):
    """(broadcast index, whether it is the last) of each block."""

    def tokens(batches):
        for batch in batches:
            found = sorted({w for text in strings(batch.column(0)) for w in words(text)})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["token"])

    vocabulary = {bytes(r[0]) for r in benchmark.where("item_id is not null").select("text").mapInArrow(tokens, "token binary").distinct().toLocalIterator()}
    counts = token_counts(docs, vocabulary) if vocabulary else {}
    blocks = _blocks(benchmark, width, block_windows)
    block = next(blocks, {})
    while block is not None:
        following = next(blocks, None)
        yield docs.sparkSession.sparkContext.broadcast(prefix_index(block, counts)), not following
        block = following or None


def _hits(docs: DataFrame, index) -> DataFrame:
    """(doc_id, th, n_words, starts, ends, items) of every row of ``docs (doc_id, th, text)`` against one block."""

    def run(batches):
        for batch in batches:
            starts, ends, items, sizes = [], [], [], []
            for text in strings(batch.column(2)):
                tokens = words(text)
                spans, of = find(tokens, index.value)
                spans = merged(spans)
                sizes.append(len(tokens)), starts.append([s for s, _ in spans]), ends.append([e for _, e in spans]), items.append(sorted(of))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["doc_id", "th", "n_words", "starts", "ends", "items"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, n_words long, starts array<int>, ends array<int>, items array<string>")


def _merged_hits(parts: list[DataFrame]) -> DataFrame:
    """Hits of several blocks, by document and text: the union of their spans and items."""
    every = reduce(DataFrame.unionByName, parts).where(F.size("starts") > 0)
    rows = every.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(batches):
        for batch in batches:
            spans = [merged(list(zip(s, e))) for s, e in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([[x[k] for x in s] for s in spans], pa.list_(pa.int32())) for k in (0, 1)], batch.column(4)], ["doc_id", "th", "starts", "ends", "items"])

    return rows.mapInArrow(run, rows.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_windows: int = 200_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items.

    ``spans`` are the merged word spans under occurring windows, ``items`` the
    sorted ids of the items these are of. A null or empty text has no words and
    no hits. Items with a null id, and items without words, are passed over;
    repeated items count once. Other columns are not read.
    """
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    parts: list[DataFrame] = []
    for index, last in _indexes(docs, benchmark, width, block_windows):
        found = _hits(own, index)
        if last and not parts:
            break
        parts.append(materialise(found, "hits"))
        index.unpersist()
    else:
        # rows of one document and text fare alike in every block
        hits = _merged_hits(parts).withColumnsRenamed({"doc_id": "of", "th": "of_th"})
        sizes = parts[0].select("doc_id", "th", "n_words")
        none = lambda c: F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c)
        found = sizes.join(hits, sizes["doc_id"].eqNullSafe(hits["of"]) & (sizes["th"] == hits["of_th"]), "left").select("doc_id", "n_words", none("starts"), none("ends"), none("items"))
    spans = F.zip_with("starts", "ends", lambda s, e: F.struct(s.alias("start"), e.alias("end")))
    found = found.withColumn("spans", spans).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans", "items")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_windows: int = 200_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no benchmark window occurs."""
    at = docs.columns.index("text")
    for index, last in _indexes(docs, benchmark, width, block_windows):

        def run(batches, index=index):
            for batch in batches:
                yield batch.filter(pa.array([not find(words(t), index.value)[0] for t in strings(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = materialise(docs, "clean")
            index.unpersist()
    return docs
