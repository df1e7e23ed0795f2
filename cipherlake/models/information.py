"""Information theory of byte strings: entropies, divergence, randomness tests, strength."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Batches of samples are read this many rows at a time.
PART = 256


def erfc(x: float) -> float:
    return math.erfc(x)


def incomplete_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: a series below a + 1, else a continued fraction (Lentz). [H14]"""
    if x <= 0 or a <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 201):
            term *= x / (a + n)
            total += term
            if abs(term) < abs(total) * 1e-14:
                break
        return total * scale
    tiny = 1e-30
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 201):
        an, b = -i * (i - a), b + 2
        d = an * d + b
        d = 1 / (d if abs(d) >= tiny else tiny)
        c = b + an / c
        c = c if abs(c) >= tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return 1 - scale * h


def byte_statistics(samples: DataFrame) -> DataFrame:
    """Integer statistics of rows (id, data binary), from which all measures follow.

    One vectorised pass over each sample's bytes in an Arrow function: exploding
    bytes to rows would multiply the data by the size of a row. Counts are exact,
    so everything after is arithmetic in the JVM.
    """
    import pyarrow as pa

    kind = samples.schema["id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for i in range(0, len(whole), PART):
                batch = whole.slice(i, PART)
                rows = [_statistics(np.frombuffer(d or b"", np.uint8)) for d in batch.column(1).to_pylist()]
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 8]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["id", "n", "hist", "pairs", "ones", "sum_x", "sum_xx", "sum_xy", "first", "above", "below", "runs"])

    return samples.select("id", "data").mapInArrow(run, f"id {kind}, n long, hist array<long>, pairs array<long>, ones long, sum_x long, sum_xx long, sum_xy long, first long, above long, below long, runs long")


def _statistics(x: np.ndarray) -> tuple:
    n = len(x)
    hist = np.bincount(x, minlength=256)
    pairs = np.unique((x[:-1].astype(np.int64) << 8) | x[1:], return_counts=True)[1] if n > 1 else np.empty(0, np.int64)
    y = x.astype(np.int64)
    above = below = runs = 0
    if n:
        median = int(np.searchsorted(np.cumsum(hist), n // 2, "right"))
        side = np.where(x == median, np.arange(n) % 2 == 0, x > median)
        above, below, runs = int(side.sum()), int((~side).sum()), 1 + int((side[1:] != side[:-1]).sum())
    ones = int((hist * np.bitwise_count(np.arange(256, dtype=np.uint8))).sum())
    return n, hist.tolist(), pairs.tolist(), ones, int(y.sum()), int((y * y).sum()), int((y[:-1] * y[1:]).sum()), int(x[0]) if n else 0, above, below, runs


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts. [D23]"""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    plus = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c / total * F.log2(c / total)).otherwise(0.0))
    return F.when(total > 0, -plus).otherwise(0.0)


def measures(samples: DataFrame) -> DataFrame:
    """Entropies, divergence from uniform, chi-squared, monobit, serial correlation and runs of each sample. [D23 to D25, E8, E9, H20]"""
    n = F.col("n")
    kl = F.aggregate("hist", F.lit(0.0), lambda a, c: a + F.when(c > 0, c / n * F.ln(c / n * 256)).otherwise(0.0))
    chi = F.aggregate("hist", F.lit(0.0), lambda a, c: a + F.pow(c - n / 256, F.lit(2.0)) / (n / 256))
    bits = n * 8
    mono = F.abs(F.col("ones") - bits / 2) / F.sqrt(bits / 2)
    below = n * F.col("sum_xx") - F.col("sum_x") * F.col("sum_x")
    serial = F.when((n < 2) | (below == 0), 0.0).otherwise(((n - 1) * F.col("sum_xy") - F.col("sum_x") * (F.col("sum_x") - F.col("first"))) / F.nullif(below, F.lit(0)))
    a, b = F.col("above").cast("double"), F.col("below").cast("double")
    m = a + b
    variance = 2 * a * b * (2 * a * b - m) / F.nullif(m * m * (m - 1), F.lit(0.0))
    z = F.when((n < 20) | (a == 0) | (b == 0) | (F.coalesce(variance, F.lit(0.0)) <= 0), 0.0).otherwise((F.col("runs") - (1 + 2 * a * b / m)) / F.sqrt(variance))
    return byte_statistics(samples).where("n > 0").select("id", "n", entropy(F.col("hist")).alias("byte_entropy"), entropy(F.col("pairs")).alias("pair_entropy"), kl.alias("kl"), chi.alias("chi2"), mono.alias("monobit"), serial.alias("serial"), z.alias("runs_z"))


def strength(samples: DataFrame, level: float = 0.01) -> DataFrame:
    """P-values, score and acceptance of samples of 32 bytes or more. [I28, H12, H14]"""
    m = measures(samples).where("n >= 32")

    def p_values(batches):
        for pdf in batches:
            pdf["chi_p"] = [max(0.0, 1 - incomplete_gamma(127.5, v / 2)) for v in pdf["chi2"]]
            pdf["mono_p"] = [erfc(v / math.sqrt(2)) for v in pdf["monobit"]]
            # a test that cannot be made passes
            pdf["runs_p"] = [1.0 if v == 0 else erfc(abs(v) / math.sqrt(2)) for v in pdf["runs_z"]]
            yield pdf

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in m.schema)
    p = m.mapInPandas(p_values, kinds + ", chi_p double, mono_p double, runs_p double")
    score = 100 - 50 * F.abs(F.col("byte_entropy") - 8) / 8 - 20 * F.least(F.col("kl") * 100, F.lit(1.0)) - 15 * F.abs("serial") - F.when(F.col("chi_p") > 0, 15 * (1 - F.col("chi_p"))).otherwise(15.0)
    weak = [(F.col("byte_entropy") < 7.5, "low byte entropy"), (F.col("kl") > 0.01, "divergence from uniform"), (F.abs("serial") > 0.05, "serial correlation"), (F.col("chi_p") < level, "chi-squared"), (F.col("runs_p") < level, "runs"), (F.col("mono_p") < level, "monobit")]
    ok = (F.col("chi_p") > level) & (F.col("runs_p") > level) & (F.col("mono_p") > level) & (F.col("kl") < 0.01) & (F.col("byte_entropy") > 7.9)
    return p.withColumns({"score": F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), "weaknesses": F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in weak])), "acceptable": ok})
