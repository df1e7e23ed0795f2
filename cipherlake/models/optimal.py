"""When to migrate: expected cost by quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def cost_curve(findings: DataFrame, now: str, deadline: str, base: float = 100_000.0, breach: float = 5_000_000.0, rate: float = 0.15, developers: int = 2, hourly: float = 150.0, steepness: float = 0.5, midpoint: float = 2032.0) -> DataFrame:
    """One row per quarter from ``now`` to before ``deadline``: migration, risk, opportunity and total cost. [I18]

    A deadline in the past becomes five years from now.
    """
    n = findings.agg(F.count("*").alias("n"), F.avg((F.col("quantum_threat") == 0).cast("double")).alias("share")).where("n > 0")
    start = F.lit(now).cast("date")
    end = F.when(F.lit(deadline).cast("date") < start, F.add_months(start, 60)).otherwise(F.lit(deadline).cast("date"))
    q = n.withColumn("share", F.when(F.col("share") == 0, 0.1).otherwise(F.col("share"))).withColumn("end", end)
    q = q.select("n", "share", "end", F.explode(F.transform(F.sequence(F.lit(0), F.lit(400)), lambda i: F.add_months(start, i * 3))).alias("quarter")).where(F.col("quarter") < F.col("end"))
    years = F.datediff("quarter", start) * 24 / F.lit(8766.0)
    migration = base / (1 + rate * years)

    def year_risk(acc, y):
        return acc + 1 / (1 + F.exp(-steepness * (y - midpoint))) * F.col("share") * 0.15 * breach * F.pow(F.lit(0.95), y - F.year(start))

    risk = F.aggregate(F.sequence(F.year(start), F.year("quarter")), F.lit(0.0), year_risk)
    urgent = F.when(F.datediff("end", "quarter") * 24 / F.lit(8766.0) < 1, 0.5).otherwise(0.0)
    opportunity = developers * hourly * F.col("n") * 4 * (1 + urgent) * 0.1
    out = q.select("quarter", migration.alias("migration"), risk.alias("risk"), opportunity.alias("opportunity"))
    return out.withColumn("total", F.col("migration") + F.col("risk") + F.col("opportunity"))


def best_quarter(curve: DataFrame) -> DataFrame:
    """The earliest cheapest quarter, its label, and the increase of the last one. [E16, H11]"""
    out = curve.agg(F.min_by("quarter", F.struct("total", "quarter")).alias("quarter"), F.min("total").alias("total"), F.max_by("total", "quarter").alias("last"))
    label = F.concat(F.lit("Q"), F.quarter("quarter").cast("string"), F.lit(" "), F.year("quarter").cast("string"))
    return out.select("quarter", label.alias("label"), "total", ((F.col("last") - F.col("total")) / F.col("total") * 100).alias("delay_increase_pct"))
