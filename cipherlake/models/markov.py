"""Markov models of migration state, of developers, and of harvest-now-decrypt-later."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

STATES, ACTIONS = 5, 4
SMOOTHING = 0.01


def state_of(readiness: Column) -> Column:
    """State from readiness, 4 is safe. [I2]"""
    return F.when(readiness >= 95, 4).when(readiness >= 70, 3).when(readiness >= 40, 2).when(readiness >= 10, 1).otherwise(0)


def states(scans: DataFrame) -> DataFrame:
    return scans.withColumn("state", state_of(F.col("readiness")))


def transition_matrix(rows: DataFrame, n: int, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, from_state, to_state, p): lag-1 transitions, smoothed, rows sum to 1. [E3, E4]"""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = rows.withColumn("from_state", F.lag(value).over(w)).where("from_state is not null").groupBy(*keys, "from_state", F.col(value).alias("to_state")).agg(F.count("*").alias("n"))
    spine = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
    spine = spine.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("from_state")).select(*keys, "from_state", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("to_state"))
    full = spine.join(seen, [*keys, "from_state", "to_state"], "left").withColumn("c", F.coalesce("n", F.lit(0)) + SMOOTHING)
    return full.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(*keys, "from_state"))).select(*keys, "from_state", "to_state", "p")


def expected_steps(t: np.ndarray, current: int) -> float:
    """Steps to the last, absorbing state. [I4]"""
    last = len(t) - 1
    if current == last:
        return 0.0
    return float(np.linalg.inv(np.eye(last) - t[:last, :last]).sum(1)[current])


def stationary(t: np.ndarray, tolerance: float = 1e-10, most: int = 10_000) -> np.ndarray:
    """By power iteration from the uniform distribution. [I3]"""
    pi = np.full(len(t), 1 / len(t))
    for _ in range(most):
        new = pi @ t
        if np.abs(new - pi).max() < tolerance:
            return new
        pi = new
    return pi


def completion(t: np.ndarray, current: int, days: float, interval: int) -> float:
    """Probability of being safe after ``days``, in scans of ``interval`` days. [I5, I7]"""
    last = len(t) - 1
    if current == last:
        return 1.0
    if days <= 0:
        return 0.0
    return float(np.linalg.matrix_power(t, max(1, math.ceil(days / interval)))[current, last])


def predict(scans: DataFrame, keys: list[str], interval: int = 7, least: int = 5) -> DataFrame:
    """One row per group of ``least`` scans or more (keys, started, readiness). [I6]

    A group's scans come as one sorted array of structs made by aggregation; the
    model itself is a few 5 x 5 products.
    """
    import pandas as pd

    rows = states(scans).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("started", "scan_id", "state"))).alias("h")).where(F.size("h") >= least)
    rows = rows.select(*keys, F.transform("h", lambda x: x["state"]).alias("history"), F.element_at("h", -1)["started"].alias("now"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                h, now = list(r["history"]), pd.Timestamp(r["now"])
                c = np.full((STATES, STATES), SMOOTHING)
                np.add.at(c, (h[:-1], h[1:]), 1)
                t, cur = c / c.sum(1, keepdims=True), h[-1]
                days = lambda y: (pd.Timestamp(y, 1, 1) - now).days
                walk, path = np.eye(STATES)[cur], []
                for _ in range(52):
                    walk = walk @ t
                    path.append(int(walk.argmax()))
                safe = next((y for y in range(now.year, now.year + 51) if completion(t, cur, days(y), interval) >= 0.5), None)
                out.append({**{k: r[k] for k in keys}, "scans": len(h), "state": int(cur), "expected_steps": expected_steps(t, cur), "regression_risk": float(t[cur, :cur].sum()), "confidence": min(1 - math.exp(-(len(h) - 1) / 10), 0.99), **{f"p{y}": completion(t, cur, days(y), interval) for y in (2027, 2028, 2029, 2030)}, "safe_year": now.year if cur == STATES - 1 else safe, "stationary": stationary(t).tolist(), "trajectory": path})
            yield pd.DataFrame(out, columns=[*keys, "scans", "state", "expected_steps", "regression_risk", "confidence", "p2027", "p2028", "p2029", "p2030", "safe_year", "stationary", "trajectory"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(run, f"{kinds}{', ' if keys else ''}scans int, state int, expected_steps double, regression_risk double, confidence double, p2027 double, p2028 double, p2029 double, p2030 double, safe_year int, stationary array<double>, trajectory array<int>")


#: Commit actions by ordinal.
ACTION_NAMES = ("introduces_vuln", "fixes_vuln", "no_crypto_change", "introduces_safe")


def developer_profiles(commits: DataFrame, least: int = 10) -> DataFrame:
    """Authors (author, ts, id, action) with ``least`` commits: action shares, risk score, likely next action. [I8, E5, F12]"""
    base = commits.groupBy("author").agg(F.count("*").alias("commits"), *[F.avg((F.col("action") == i).cast("double")).alias(f"share_{i}") for i in range(ACTIONS)], F.max_by("action", F.struct("ts", "id")).alias("last_action")).where(F.col("commits") >= least)
    base = base.withColumn("risk", F.least(F.greatest(100 * (F.col("share_0") - F.col("share_1") + 1) / 2, F.lit(0.0)), F.lit(100.0)))
    moves = transition_matrix(commits, ACTIONS, ["author"], ["ts", "id"], "action").withColumnRenamed("author", "a")
    met = base.join(moves, (F.col("author") == F.col("a")) & (F.col("last_action") == F.col("from_state")))
    best = met.groupBy("author").agg(F.max_by("to_state", F.struct("p", -F.col("to_state"))).alias("next_action"), F.max("p").alias("next_p"))
    return base.join(best, "author")


def availability(year: Column, steepness: Column, midpoint: Column) -> Column:
    """Logistic curve of quantum availability. [H15]"""
    return 1 / (1 + F.exp(-steepness * (year - midpoint)))


def hndl_years(parameters: DataFrame) -> DataFrame:
    """Yearly state distribution of the harvest chain for rows (id, harvest, vulnerability, value, steepness, midpoint, start, end). [I9, E13]

    One fold over the years per parameter row; the fold keeps every year.
    """
    p = F.col
    zero = F.array(F.struct(p("start").alias("year"), *[F.lit(float(i == 0)).alias(f"s{i}") for i in range(5)], F.lit(0.0).alias("pq")))

    def step(acc, year):
        s = F.element_at(acc, -1)
        pq = availability(year, p("steepness"), p("midpoint"))
        clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
        h, d, x = clamp(p("harvest")), clamp(pq * p("vulnerability")), clamp(p("value"))
        return F.concat(acc, F.array(F.struct(
            year.alias("year"), (s["s0"] * (1 - h)).alias("s0"), (s["s0"] * h + s["s1"] * (1 - pq)).alias("s1"),
            (s["s1"] * pq + s["s2"] * (1 - d)).alias("s2"), (s["s2"] * d + s["s3"] * (1 - x)).alias("s3"), (s["s3"] * x + s["s4"]).alias("s4"), pq.alias("pq"),
        )))

    years = parameters.withColumn("y", F.aggregate(F.sequence(F.col("start") + 1, F.col("end")), zero, step))
    # explode would infer a filter on the fold's size and push it below the parameters' aggregation, to every finding
    return years.select("id", F.explode_outer("y").alias("y")).select("id", "y.*")


def hndl_summary(years: DataFrame) -> DataFrame:
    """Peak, expected year, level and mean risk of each parameter row. [I9]"""
    w = Window.partitionBy("id").orderBy("year")
    m = years.withColumn("gain", F.col("s4") - F.lag("s4").over(w)).withColumn("gain", F.when(F.col("gain") > 0, F.col("gain")))
    out = m.groupBy("id").agg(F.max("s4").alias("peak"), F.sum(F.col("year") * F.col("gain")).alias("wy"), F.sum("gain").alias("g"), (F.sum("s4") / (F.max("year") - F.min("year"))).alias("mean_risk"))
    level = F.when(F.col("peak") >= 0.7, "CRITICAL").when(F.col("peak") >= 0.4, "HIGH").when(F.col("peak") >= 0.15, "MEDIUM").otherwise("LOW")
    return out.select("id", "peak", F.round(F.col("wy") / F.nullif("g", F.lit(0.0))).cast("int").alias("expected_year"), level.alias("level"), "mean_risk")


def hndl_parameters(findings: DataFrame, start: int, retention: int = 10) -> DataFrame:
    """The distinct parameter sets of findings that Shor's algorithm breaks; at most 40. [I10]"""
    value = F.when(F.col("category").isin(0, 2), 0.9).when(F.col("category").isin(1, 7), 0.7).when(F.col("category") == 3, 0.6).otherwise(0.5)
    if 0 < retention < 5:
        value = value * (retention / 5.0)
    harvest = F.when(F.col("severity") == 0, 0.25).when(F.col("severity") == 1, 0.20).when(F.col("severity") == 2, 0.15).otherwise(0.10)
    sets = findings.where("quantum_threat = 0").select("category", "severity").distinct()
    return sets.select(F.concat_ws("-", "category", "severity").alias("id"), harvest.alias("harvest"), F.lit(1.0).alias("vulnerability"), value.alias("value"), F.lit(0.5).alias("steepness"), F.lit(2032.0).alias("midpoint"), F.lit(start).alias("start"), F.lit(start + retention + 5).alias("end"))


def hndl_findings(findings: DataFrame, start: int) -> DataFrame:
    """Findings with the risk of their parameter set, computed once per set and joined back. [I10]"""
    risk = F.broadcast(hndl_summary(hndl_years(hndl_parameters(findings, start))))
    return findings.where("quantum_threat = 0").withColumn("id", F.concat_ws("-", "category", "severity")).join(risk, "id")
