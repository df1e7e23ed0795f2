"""All models over one set of findings, and how well they are calibrated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from cipherlake.models import bayes, graphs, markov, montecarlo, optimal
from cipherlake.operators.relational import scans


def modules(findings: DataFrame, items: DataFrame, now: str = "2026-01-01", deadline: str = "2033-01-01", simulations: int = 100) -> dict[str, Callable[[], DataFrame]]:
    """Each model as a function that builds its lazy result; a module with too little input gives no rows. [I30]"""
    history = scans(findings).withColumn("project", F.lit("all"))
    start = int(now[:4])
    embedded = items.select(F.col("item").alias("id"), graphs.embed(items).alias("vector"))
    return {
        "bayes": lambda: bayes.false_positive_rate(bayes.posterior(findings)),
        "markov": lambda: markov.predict(history, ["project"]),
        "harvest": lambda: markov.hndl_summary(markov.hndl_years(markov.hndl_parameters(findings, start))),
        "simulation": lambda: montecarlo.summarise(montecarlo.simulations(montecarlo.draws(items, simulations))),
        "timing": lambda: optimal.best_quarter(optimal.cost_curve(findings, now, deadline)),
        "topology": lambda: graphs.persistence_entropy(graphs.persistence(graphs.distances(embedded))),
    }


def overview(findings: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(module, rows, result as JSON) of all modules."""
    out = None
    for name, build in modules(findings, items, **how).items():
        part = build().select(F.to_json(F.struct("*")).alias("result")).agg(F.count("*").alias("rows"), F.min("result").alias("first")).select(F.lit(name).alias("module"), "rows", "first")
        out = part if out is None else out.unionByName(part)
    return out


def calibrate(findings: DataFrame, items: DataFrame, simulations: int = 100) -> DataFrame:
    """Markov error (1 less confidence) and the relative error of simulated hours against the expectation. [I29]"""
    history = scans(findings).withColumn("project", F.lit("all"))
    chain = markov.predict(history, ["project"]).select(F.lit("markov").alias("model"), (1 - F.col("confidence")).alias("error"))
    drawn = montecarlo.draws(items, simulations)
    p = montecarlo.DEFAULTS
    quick = F.col("in_dependency") | F.col("auto_fix")
    expected = items.agg(F.sum(F.when(quick, F.exp(F.lit(p["auto_mu"] + p["auto_sigma"] ** 2 / 2))).otherwise(F.exp(F.lit(p["manual_mu"] + p["manual_sigma"] ** 2 / 2)))).alias("expected"))
    seen = drawn.groupBy("sim").agg(F.sum("hours").alias("h")).agg(F.avg("h").alias("seen"))
    simulated = seen.crossJoin(expected).select(F.lit("simulation").alias("model"), (F.abs(F.col("seen") - F.col("expected")) / F.col("expected")).alias("error"))
    return chain.unionByName(simulated)
