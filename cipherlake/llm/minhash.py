"""Near-duplicate documents by min-max hashing.

A document's word shingles are hashed once to 64 bits. Under each of ``k``
permutations both the smallest and the largest value are kept: either agrees
between two sets with probability equal to their Jaccard similarity, so ``2k``
signature values cost ``k`` hash evaluations, and the estimate over them has a
lower variance than ``k`` minima alone. Bands of four values make buckets.

Scale. Documents with equal sets collapse to one class by aggregation first, so
copies never meet in a bucket. In a bucket each member is compared with one
leader, not with every other member: the pairs are linear in the members. The
leader is the member whose buckets hold most documents, which for edited copies
is their source. Links are confirmed on whole sets. What a leader cannot join
is finished exactly: a bucket whose members are still in different components
has members of different components compared directly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cipherlake.functions.components import components
from cipherlake.functions.storage import materialise
from cipherlake.llm.common import BLOCK, LOWER, open_blocks, parts, possibly_in, strings

ROWS = 4
#: The chance to miss a pair at the threshold is below this.
MISS = 1e-5
#: Set elements hashed at a time; bounds the memory a very long text takes.
CHUNK = 1 << 14
#: Shared elements, and members, of a block that are compared at a time; they bound a worker's memory beside the n x n counts.
COLUMNS, MEMBERS = 1024, 128
_SCHEMA = "doc_id long, n_shingles long, k1 long, k2 long, sig array<int>"


def bands_for(threshold: float) -> int:
    """An even number of bands that misses a pair at ``threshold`` with a chance below ``MISS``.

    Two bands above what independent bands need: the least and the largest value
    under one permutation depend on each other, a little.
    """
    n = math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))
    return n + n % 2 + 2


class _Words(dict):
    """64-bit word hashes, kept for words met before; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, width: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than ``width`` are one shingle."""
    tokens = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, (n, 1), np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, (n, 1), np.uint64)


def min_max(values: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """min, max, min, max, ... of the high halves under each permutation."""
    low = np.full(len(mul), 0xFFFFFFFF, np.uint64)
    high = np.zeros(len(mul), np.uint64)
    for i in range(0, len(values), CHUNK):
        x = (((values[None, i : i + CHUNK] ^ add) * mul) >> np.uint64(32))
        low, high = np.minimum(low, x.min(1)), np.maximum(high, x.max(1))
    return np.stack([low, high], 1).reshape(-1).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """Per row: doc_id, set size, 128-bit key of the set, min-max signature (null for an empty set)."""
    n = bands_for(threshold) * ROWS // 2

    def run(batches):
        words, (mul, add) = _Words(), permutations(n)
        for batch in parts(batches):
            sizes, k1, k2, sigs = [], [], [], []
            for text in strings(batch.column(1)):
                s = shingle_set(text, width, words)
                sizes.append(len(s))
                if not len(s):
                    k1.append(None), k2.append(None), sigs.append(None)
                    continue
                a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                k1.append(int(a)), k2.append(int(b)), sigs.append(min_max(s, mul, add))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "k1", "k2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCHEMA)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        words = _Words()
        for batch in parts(batches):
            sets = [shingle_set(t, width, words).view(np.int64) for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "elems"])

    return docs.mapInArrow(run, "id long, elems array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs (u, v)`` whose whole sets are similar enough."""
    u, v = (sets.select(F.col("id").alias(x), F.col("elems").alias(f"e{x}")) for x in "uv")
    common = F.size(F.array_intersect("eu", "ev"))
    return pairs.join(v, "v").join(u, "u").where(100 * common >= percent * (F.size("eu") + F.size("ev") - common)).select("u", "v")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their distinct
    ``width``-word shingles is ``threshold`` or more (in whole percent, compared
    in integers). ``component_id`` is the smallest doc_id reachable over links,
    ``kept`` says that it is the row's own. A text without words (null, empty,
    blank) has an empty set and is linked with nothing. Repeated rows are in one
    component and share ``kept``; a row with a null doc_id takes part in no link
    and has a null component and ``kept`` true. Other columns are not read.
    """
    percent = round(100 * threshold)
    sigs = materialise(signatures(docs, width, percent / 100), "signatures")
    usable = sigs.where("doc_id is not null and sig is not null")
    classes = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    keys = [F.xxhash64(F.lit(i), *[F.col("sig")[ROWS * i + j] for j in range(ROWS)]) for i in range(bands_for(percent / 100))]
    banded = materialise(classes.select(F.col("rep").alias("id"), F.explode(F.array(*keys)).alias("bucket")), "bands")
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = banded.join(crowded, "bucket")
    mass = met.groupBy("id").agg(F.sum("n").alias("mass"))
    # a crowded bucket is dealt to several tasks, and its leader to each
    salts = F.ceil(F.col("n") / BLOCK).cast("int")
    met = materialise(met.join(mass, "id").select("bucket", "id", "mass", salts.alias("salts"), F.pmod(F.xxhash64(F.lit(5), "id"), salts).cast("int").alias("salt")), "met")
    ids = materialise(met.select("id").distinct(), "ids")
    texts = possibly_in(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), ids, "id")
    # an inner join: a semi join would be pushed below the filter
    sets = materialise(_sets(texts.join(ids, "id"), width), "sets")
    lead = met.groupBy("bucket").agg(F.max(F.struct("mass", "id")).alias("top"), F.max("salts").alias("salts"))
    lead = lead.select("bucket", F.col("top.id").alias("u"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = met.join(lead, ["bucket", "salt"]).where("id <> u").select("u", F.col("id").alias("v")).distinct()
    links = materialise(_confirmed(pairs, sets, percent), "confirmed")
    comp = components(links)
    rest = open_blocks(met, comp, sets.withColumn("weight", F.size("elems")))
    more = materialise(rest.groupBy("bucket", "i", "j").applyInPandas(_links_in_block(percent), "u long, v long").distinct(), "rest")
    comp = components(links.select("u", "v").union(more))
    named = classes.select("k1", "k2", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    known = sigs.withColumn("linked", F.col("doc_id").isNotNull() & F.col("sig").isNotNull())
    out = known.where("linked").join(named, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    alone = known.where("not linked").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` less the near duplicates: of each component the row with the smallest doc_id stays, with all its columns.

    Of rows that repeat a doc_id one stays, that with the smallest text hash.
    Rows without words, and rows with a null doc_id, stay.
    """
    found = near_duplicates(docs, width, threshold)
    rest = docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    again = materialise(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return rest
    once = rest.join(again, "doc_id", "left_semi").withColumn("__h", F.xxhash64("text"))
    first = once.groupBy("doc_id").agg(F.min("__h").alias("__h"))
    return rest.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.join(first, ["doc_id", "__h"], "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))


def _links_in_block(percent: int):
    """Links across components within one pair of blocks, as edges to the smallest member reached."""

    def run(rows):
        import pandas as pd

        ids, comps = rows["id"].to_numpy(), rows["comp"].to_numpy()
        if len(set(comps)) < 2:
            return pd.DataFrame({"u": ids[:0], "v": ids[:0]})
        sizes = np.array([len(x) for x in rows["elems"]])
        n, elems = len(ids), np.concatenate(rows["elems"].to_list())
        order = np.argsort(elems)
        elems, row = elems[order], np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
        del order
        new = np.append(True, elems[1:] != elems[:-1])
        shared = ~(new & np.append(new[1:], True))
        del elems
        # places of members and of what two of them have at least, in the order of the latter
        row, col = row[shared], np.cumsum(new[shared], dtype=np.int32) - 1
        both = np.zeros((n, n), np.float32)
        for start in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
            a, b = np.searchsorted(col, (start, start + COLUMNS))
            has = np.zeros((n, COLUMNS), np.float32)
            has[row[a:b], col[a:b] - start] = 1
            both += has @ has.T
        link = np.empty((n, n), bool)
        for i in range(0, n, MEMBERS):
            common = both[i : i + MEMBERS].astype(np.int64)
            link[i : i + MEMBERS] = (100 * common >= percent * (sizes[i : i + MEMBERS, None] + sizes[None, :] - common)) & (comps[i : i + MEMBERS, None] != comps[None, :])
        label = ids.copy()
        while True:
            reached = [np.where(link[i : i + MEMBERS], label[None, :], np.iinfo(np.int64).max).min(1) for i in range(0, n, MEMBERS)]
            new = np.minimum(label, np.concatenate(reached))
            if (new == label).all():
                break
            label = new
        far = label != ids
        return pd.DataFrame({"u": ids[far], "v": label[far]})

    return run
