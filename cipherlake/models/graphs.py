"""Graphs: Laplacians and migration phases; topological clusters of findings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cipherlake.functions.components import components
from cipherlake.functions.labels import category_label, threat_label
from cipherlake.models.signals import dot

#: Numbers of an embedded finding.
DIMENSIONS = 17


def laplacian(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Entries (i, j, value) of D - W for undirected edges (a, b) and node weights (node, findings). [I19, C9]

    An edge weighs the findings on both its ends, at least 1.
    """
    und = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    w = weights.select("node", "findings")
    met = und.join(w.select(F.col("node").alias("a"), F.col("findings").alias("fa")), "a", "left").join(w.select(F.col("node").alias("b"), F.col("findings").alias("fb")), "b", "left")
    sym = met.select("a", "b", F.greatest(F.coalesce("fa", F.lit(0)) + F.coalesce("fb", F.lit(0)), F.lit(1)).cast("double").alias("w"))
    both = sym.select(F.col("a").alias("i"), F.col("b").alias("j"), "w").union(sym.select("b", "a", "w"))
    return both.select("i", "j", (-F.col("w")).alias("value")).union(both.groupBy("i").agg(F.sum("w").alias("value")).select("i", F.col("i").alias("j"), "value"))


def degrees(entries: DataFrame) -> DataFrame:
    return entries.where("i = j").select(F.col("i").alias("node"), F.col("value").alias("degree"))


def kmeans(x: np.ndarray, k: int, seed: int = 42, most: int = 100) -> np.ndarray:
    """Labels by k-means with spread-out seeding. [I21]"""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:
        d = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centres)
    for _ in range(most):
        label = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return label


def spectral_phases(entries: DataFrame, k: int = 4) -> DataFrame:
    """(node, part, fiedler) by the smallest eigenvectors of the Laplacian (i, j, value). [I20, I22]

    The dense decomposition is for graphs of a few thousand nodes, as of
    packages or services: it runs in one task.
    """
    import pandas as pd

    kind = entries.schema["i"].dataType.simpleString()

    def run(pdf):
        nodes = np.array(sorted(set(pdf["i"]) | set(pdf["j"])))
        at = {v: n for n, v in enumerate(nodes)}
        m = np.zeros((len(nodes), len(nodes)))
        m[[at[v] for v in pdf["i"]], [at[v] for v in pdf["j"]]] = pdf["value"]
        values, vectors = np.linalg.eigh(m)
        parts = min(k, len(nodes))
        first = np.array([v[np.flatnonzero(np.abs(v) > 1e-9)[0]] if (np.abs(v) > 1e-9).any() else 1.0 for v in vectors.T])
        vectors = vectors * np.where(first < 0, -1, 1)  # a sign that does not depend on the solver
        second = vectors[:, 1] if len(nodes) > 1 else vectors[:, 0]
        return pd.DataFrame({"node": nodes, "part": kmeans(vectors[:, 1:parts] if parts > 1 else vectors, parts), "fiedler": second})

    return entries.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(lambda pdf: run(pdf), f"node {kind}, part int, fiedler double")


def phase_order(parts: DataFrame, weights: DataFrame) -> DataFrame:
    """Parts (node, part) as phases, the most critical findings first. [D30, F8]"""
    sums = parts.join(weights, "node", "left").groupBy("part").agg(F.count("*").alias("nodes"), F.sum(F.coalesce("findings", F.lit(0))).alias("findings"), F.sum(F.coalesce("critical", F.lit(0))).alias("critical"))
    return sums.withColumn("phase", F.row_number().over(Window.orderBy(F.desc("critical"), F.desc("findings"), "part")))


def cut(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """Cut, volume and normalised cut of each part. [I22]"""
    p, q = parts.select(F.col("node").alias("i"), F.col("part").alias("pi")), parts.select(F.col("node").alias("j"), F.col("part").alias("pj"))
    met = entries.where("i <> j").join(p, "i").join(q, "j")
    out = met.groupBy(F.col("pi").alias("part")).agg((-F.sum(F.when(F.col("pi") != F.col("pj"), F.col("value")).otherwise(0.0))).alias("cut"), (-F.sum("value")).alias("volume"))
    return out.withColumn("ncut", F.col("cut") / F.nullif("volume", F.lit(0.0)))


def cross_edges(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, cross_edges): edges of the Laplacian that leave each part. [D30]"""
    p, q = parts.select(F.col("node").alias("i"), F.col("part").alias("part")), parts.select(F.col("node").alias("j"), F.col("part").alias("other"))
    return entries.where("i <> j").join(p, "i").join(q, "j").groupBy("part").agg(F.count_if(F.col("part") != F.col("other")).alias("cross_edges"))


def path_hash(path: Column) -> Column:
    """h = 31 h + code point modulo 2^64, then the last four digits over 10000. [H16]

    Exact in decimals: each step is reduced modulo 2^64.
    """
    wrap = F.lit("18446744073709551616").cast("decimal(25,0)")
    points = F.transform(F.filter(F.split(path, ""), lambda c: c != ""), lambda c: F.ascii(c))
    h = F.aggregate(points, F.lit(0).cast("decimal(25,0)"), lambda a, c: ((a * 31 + c) % wrap).cast("decimal(25,0)"))
    return (h % 10000).cast("double") / 10000


def embed(findings: DataFrame) -> Column:
    """The 17 numbers of a finding. [H18]"""
    has = lambda c: c in findings.columns
    sensitive = F.when(F.col("data_sensitivity") != "", 1.0).otherwise(0.0) if has("data_sensitivity") else F.lit(0.0)
    depth = F.least(F.size("dependency_chain") / 10.0, F.lit(1.0)) if has("dependency_chain") else F.lit(0.0)
    head = [1 - F.col("severity") / 3.0, 1 - F.col("quantum_threat") / 2.0, sensitive, F.col("in_dependency").cast("double"), depth, F.col("confidence"), path_hash(F.col("file_path"))]
    return F.array(*head, *[(F.col("category") == i).cast("double") for i in range(10)])


def distances(items: DataFrame) -> DataFrame:
    """(i, j, distance) of all pairs i < j of items (id, vector). [C10, H17]

    For a bounded set of items only: its size squared is the result's.
    """
    a, b = items.select(F.col("id").alias("i"), F.col("vector").alias("u")), items.select(F.col("id").alias("j"), F.col("vector").alias("v"))
    d = F.zip_with("u", "v", lambda x, y: x - y)
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", F.sqrt(dot(d, d)).alias("distance"))


def persistence(edges: DataFrame) -> DataFrame:
    """Deaths of components (i, j, death) as distance grows: the minimum spanning forest of (i, j, distance). [I23, G5]

    Edges are cut down to each partition's own forest first, which cannot lose
    an edge of the whole one; the rest, fewer than nodes times partitions, meet.
    """
    import pandas as pd

    kind = edges.schema["i"].dataType.simpleString()
    out = f"i {kind}, j {kind}, distance double"

    def forest(pdf):
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        keep = []
        for i, j, d in pdf.sort_values(["distance", "i", "j"]).itertuples(index=False):
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                keep.append((i, j, d))
        return pd.DataFrame(keep, columns=["i", "j", "distance"])

    def local(batches):
        rest = pd.DataFrame(columns=["i", "j", "distance"])
        for pdf in batches:
            rest = forest(pd.concat([rest, pdf]) if len(rest) else pdf)
        if len(rest):
            yield rest

    part = edges.select("i", "j", "distance").mapInPandas(local, out)
    return part.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda pdf: forest(pdf[["i", "j", "distance"]]), out).withColumnRenamed("distance", "death")


def persistence_entropy(pairs: DataFrame) -> DataFrame:
    """-sum of r ln r of the deaths' shares. [I23]"""
    total = pairs.agg(F.sum("death").alias("total"))
    r = F.col("death") / F.nullif("total", F.lit(0.0))
    return pairs.crossJoin(F.broadcast(total)).agg(F.coalesce(-F.sum(F.when(F.col("death") > 0, r * F.ln(r))), F.lit(0.0)).alias("entropy"))


def clusters(items: DataFrame, edges: DataFrame, share: float = 0.3) -> DataFrame:
    """(id, cluster): items joined by edges (i, j, distance) of at most ``share`` of the longest; the cluster is its smallest id. [I23]"""
    longest = edges.agg(F.max("distance").alias("most"))
    near = edges.crossJoin(F.broadcast(longest)).where(F.col("distance") <= share * F.col("most")).select(F.col("i").alias("u"), F.col("j").alias("v"))
    joined = components(near).withColumnRenamed("node", "id")
    return items.select("id").join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def cluster_summaries(items: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """Each cluster's size, centre, largest distance within and description, the largest first. [I23, D27, D28, F9]

    ``items`` have id, vector, category and quantum_threat, ``members`` come from
    ``clusters``. Of equally frequent categories or threats the smaller ordinal
    is the dominant one. A cluster of one is ``isolated`` and has the distance 0.
    """
    inside = edges.join(members.select(F.col("id").alias("i"), "cluster"), "i").join(members.select(F.col("id").alias("j"), F.col("cluster").alias("other")), "j")
    widest = inside.where("cluster = other").groupBy("cluster").agg(F.max("distance").alias("diameter"))
    centre = F.array(*[F.avg(F.get("vector", F.lit(k))) for k in range(DIMENSIONS)])
    by = items.join(members, "id").groupBy("cluster").agg(F.count("*").alias("n"), F.mode("category", True).alias("category"), F.mode("quantum_threat", True).alias("threat"), centre.alias("centre"))
    text = F.concat(F.col("n").cast("string"), F.lit(" findings, primarily "), category_label(F.col("category")), F.lit(" ("), threat_label(F.col("threat")), F.lit(" threat)"))
    out = by.join(widest, "cluster", "left").select("cluster", "n", (F.col("n") == 1).alias("isolated"), F.coalesce("diameter", F.lit(0.0)).alias("diameter"), "centre", text.alias("description"))
    return out.orderBy(F.desc("n"), "cluster")


def top_merges(pairs: DataFrame, n: int = 5) -> DataFrame:
    """(rank, feature): the ``n`` merges of ``persistence`` that come last, as text. [I23, F9]"""
    most = pairs.orderBy(F.desc("death")).limit(n).select("death", F.row_number().over(Window.orderBy(F.desc("death"))).alias("rank"))
    return most.select("rank", F.format_string("component merge at d=%.3f (persistence=%.3f)", "death", "death").alias("feature"))
