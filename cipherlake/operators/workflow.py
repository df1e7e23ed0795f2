"""The life of a finding: requested transitions, deadlines, breaches, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Statuses, and the transitions that are allowed.
STATUSES = ("new", "triaged", "assigned", "in_progress", "in_review", "fixed", "verified", "wont_fix", "false_positive", "accepted_risk")
TRANSITIONS = (
    ("new", "triaged"),
    ("new", "false_positive"),
    ("triaged", "assigned"),
    ("triaged", "wont_fix"),
    ("triaged", "false_positive"),
    ("assigned", "in_progress"),
    ("assigned", "wont_fix"),
    ("in_progress", "in_review"),
    ("in_progress", "assigned"),
    ("in_review", "fixed"),
    ("in_review", "in_progress"),
    ("fixed", "verified"),
    ("fixed", "in_progress"),
    ("wont_fix", "triaged"),
    ("false_positive", "triaged"),
    ("accepted_risk", "triaged"),
)
#: Days to fix by severity.
SLA_DAYS = (14, 30, 90, 180)
CLOSED = ("fixed", "verified", "wont_fix", "false_positive")


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "from_status string, to_status string")


def allowed(start: Column, end: Column) -> Column:
    """Whether a move is allowed: membership of a pair in a constant set. [C13]"""
    return F.concat_ws(">", start, end).isin(*[f"{a}>{b}" for a, b in TRANSITIONS])


def after_request(status: Column, want: Column) -> Column:
    """The status after a request: refused moves change nothing."""
    return F.when(allowed(status, want), want).otherwise(status)


def after_assignment(status: Column) -> Column:
    """Assigning moves a new or triaged finding at once, whatever the transitions say."""
    return F.when(status.isin("new", "triaged"), "assigned").otherwise(status)


def fold(findings: DataFrame, requests: DataFrame) -> DataFrame:
    """Status, time of the last accepted move and number of moves of each finding. [J5]

    ``findings (finding_id, created_at, severity)``, ``requests (finding_id, ts,
    id, to_status)``. A finding's requests are one array in order, folded by a
    JVM expression.
    """
    history = requests.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "to_status"))).alias("h"))
    rows = findings.join(history, "finding_id", "left")
    zero = F.struct(F.lit("new").alias("status"), F.col("created_at").alias("at"), F.lit(0).alias("moves"))

    def step(acc, r):
        ok = allowed(acc["status"], r["to_status"])
        return F.struct(F.when(ok, r["to_status"]).otherwise(acc["status"]).alias("status"), F.when(ok, r["ts"]).otherwise(acc["at"]).alias("at"), (acc["moves"] + ok.cast("int")).alias("moves"))

    rows = rows.withColumn("s", F.aggregate(F.coalesce("h", F.array().cast("array<struct<ts:timestamp_ntz,id:bigint,to_status:string>>")), zero, step))
    return rows.select("finding_id", "created_at", "severity", "s.status", F.col("s.at").alias("updated_at"), "s.moves")


def with_deadline(states: DataFrame) -> DataFrame:
    days = F.element_at(F.array(*[F.lit(d) for d in SLA_DAYS]), F.greatest(F.least(F.col("severity"), F.lit(3)), F.lit(0)) + 1)
    return states.withColumn("deadline", F.col("created_at") + F.make_dt_interval(days))


def is_breached(now: str) -> Column:
    return ~F.col("status").isin(*CLOSED) & (F.lit(now).cast("timestamp_ntz") > F.col("deadline"))


def breaches(states: DataFrame, now: str) -> DataFrame:
    """Open findings past their deadline; accepted risks count as open. [J6]"""
    return states.where(is_breached(now))


def progress(states: DataFrame, now: str) -> DataFrame:
    """Totals by status, share done, mean hours to a fix, breaches. [D16]"""
    is_ = lambda *xs: F.col("status").isin(*xs)
    hours = (F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 3.6e9
    out = states.agg(F.count("*").alias("total"), F.count_if(is_("fixed")).alias("fixed"), F.count_if(is_("verified")).alias("verified"), F.count_if(is_("in_progress", "in_review")).alias("in_progress"), F.avg(F.when(is_("fixed", "verified"), hours)).alias("h"), F.count_if(is_breached(now)).alias("sla_breaches"))
    done = F.col("fixed") + F.col("verified")
    return out.select("total", "fixed", "verified", "in_progress", (F.col("total") - done).alias("remaining"), F.round(F.when(F.col("total") > 0, done / F.greatest("total", F.lit(1)) * 100).otherwise(0.0), 6).alias("progress_pct"), F.round(F.coalesce("h", F.lit(0.0)), 4).alias("mean_fix_hours"), "sla_breaches")
