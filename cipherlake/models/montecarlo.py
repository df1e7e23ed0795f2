"""Monte Carlo migration times, reproducible by hashed uniforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: 2**52, over which the first 13 hex digits of a digest are a uniform.
UNIT = 4503599627370496.0
DEFAULTS = {"auto_mu": 0.5, "auto_sigma": 0.3, "manual_mu": 4.0, "manual_sigma": 2.0, "dependency_days": 30.0, "regression": 0.0, "hourly": 150.0}


def uniform(*parts: Column) -> Column:
    """A uniform in (0, 1) that depends on ``parts`` alone: reruns, retries and repartitioning agree. [I15]"""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(UNIT)


def normal(*parts: Column) -> Column:
    """A standard normal by the Box-Muller transform."""
    return F.sqrt(-2 * F.ln(uniform(*parts, F.lit("a")))) * F.cos(2 * F.pi() * uniform(*parts, F.lit("b")))


def lognormal(mu, sigma, *parts: Column) -> Column:
    """Location and scale are of the logarithm. [I16]"""
    return F.exp(mu + sigma * normal(*parts))


def exponential(mean, *parts: Column) -> Column:
    return -mean * F.ln(uniform(*parts, F.lit("e")))


def draws(items: DataFrame, simulations: int, seed: int = 42, **overrides) -> DataFrame:
    """(sim, item, hours, wait_days) of work items (item, auto_fix, in_dependency), ``simulations`` of each.

    Items are exploded to their simulations where they are; nothing is joined.
    """
    p = DEFAULTS | overrides
    rows = items.select("item", "auto_fix", "in_dependency", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))).alias("sim"))
    key = (F.lit(seed), F.col("sim"), F.col("item"))
    quick = F.col("in_dependency") | F.col("auto_fix")
    mu, sigma = F.when(quick, p["auto_mu"]).otherwise(p["manual_mu"]), F.when(quick, p["auto_sigma"]).otherwise(p["manual_sigma"])
    wait = F.when(F.col("in_dependency"), exponential(p["dependency_days"], *key)).otherwise(0.0)
    return rows.select("sim", "item", lognormal(mu, sigma, *key).alias("hours"), wait.alias("wait_days"))


def simulations(drawn: DataFrame, interval_days: int = 7, seed: int = 42, **overrides) -> DataFrame:
    """One row per simulation: total hours, wall-clock weeks, cost, regressions. [I15]"""
    p = DEFAULTS | overrides
    sums = drawn.groupBy("sim").agg(F.sum("hours").alias("hours"), F.max("wait_days").alias("wait"), F.count("*").alias("items"))
    wall = F.greatest(F.col("hours") / F.greatest(F.lit(1), F.ceil(F.col("items") / 10)), F.col("wait") * 8)
    sums = sums.withColumn("wall", wall).withColumn("sprints", F.ceil(F.col("wall") / 40 / (interval_days / 7)).cast("int"))
    if p["regression"] > 0:
        hit = lambda i: uniform(F.lit(seed), F.col("sim"), F.lit("r"), i) < p["regression"]
        fix = lambda i: F.when(hit(i), lognormal(2.0, 1.0, F.lit(seed), F.col("sim"), F.lit("f"), i)).otherwise(0.0)
        each = F.sequence(F.lit(1), F.col("sprints"))
        sums = sums.withColumn("regressions", F.size(F.filter(each, hit))).withColumn("wall", F.col("wall") + F.aggregate(F.transform(each, fix), F.lit(0.0), lambda a, x: a + x))
    else:
        sums = sums.withColumn("regressions", F.lit(0))
    return sums.select("sim", "hours", (F.col("wall") / 40).alias("weeks"), (F.col("hours") * p["hourly"]).alias("cost"), "regressions")


def summarise(sims: DataFrame) -> DataFrame:
    """Mean and interpolated percentiles of weeks and cost. [D19, D20]"""
    q = lambda c, p: F.percentile(c, p)
    return sims.agg(F.avg("weeks").alias("mean_weeks"), q("weeks", 0.1).alias("p10_weeks"), q("weeks", 0.5).alias("p50_weeks"), q("weeks", 0.9).alias("p90_weeks"), F.avg("cost").alias("mean_cost"), q("cost", 0.5).alias("p50_cost"), q("cost", 0.9).alias("p90_cost"))


def completion_curve(sims: DataFrame) -> DataFrame:
    """Share of simulations done by each week. [D21]

    Weeks are counted once by their ceiling; the running sum is over one row per
    week, not over the simulations.
    """
    by = sims.groupBy(F.greatest(F.ceil("weeks"), F.lit(1)).cast("long").alias("week")).agg(F.count("*").alias("n"))
    last = by.agg(F.max("week").alias("last"), F.sum("n").alias("total"))
    spine = last.select("total", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("week"))
    full = spine.join(by, "week", "left")
    return full.select("week", (F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("week").rowsBetween(Window.unboundedPreceding, 0)) / F.col("total")).alias("share"))


def variance_ranking(drawn: DataFrame) -> DataFrame:
    """Each item's mean, deviation and share of the total variance of hours. [D22]"""
    per = drawn.groupBy("item").agg(F.avg("hours").alias("mean_hours"), F.var_pop("hours").alias("v"))
    total = per.agg(F.sum("v").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("item", "mean_hours", F.sqrt("v").alias("sd_hours"), F.when(F.col("total") > 0, F.col("v") / F.nullif("total", F.lit(0.0))).otherwise(0.0).alias("share"))


def sensitivity(items: DataFrame, simulations_: int) -> DataFrame:
    """Mean weeks with four parameters 20 % lower and higher; index is the spread over the base. [I17]"""
    base = summarise(simulations(draws(items, simulations_))).select(F.col("mean_weeks").alias("base"))
    out = None
    for name in ("auto_mu", "manual_mu", "dependency_days", "regression"):
        low, high = (summarise(simulations(draws(items, simulations_, **{name: DEFAULTS[name] * f}))).select(F.col("mean_weeks").alias(c)) for f, c in ((0.8, "low"), (1.2, "high")))
        row = low.crossJoin(high).crossJoin(base).select(F.lit(name).alias("parameter"), "low", "high", "base")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("index", F.abs(F.col("high") - F.col("low")) / F.col("base"))
