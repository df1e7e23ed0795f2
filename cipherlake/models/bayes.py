"""Which findings are real: naive Bayes over context signals, and analyst feedback."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from functools import reduce

# Fixed values: (signal, P(signal | real), P(signal | false alarm)).
SIGNALS = (
    ("is_test_file", 0.15, 0.60),
    ("in_comment", 0.02, 0.30),
    ("variable_name_contains_test", 0.05, 0.40),
    ("in_example_code", 0.10, 0.50),
    ("in_deprecated_block", 0.30, 0.15),
    ("high_severity_rule", 0.80, 0.40),
    ("in_dependency_signal", 0.85, 0.30),
    ("called_in_production_path", 0.90, 0.20),
)


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def signals(findings: DataFrame) -> DataFrame:
    """``findings`` with one boolean column per signal. [B24]"""
    path, code = F.lower("file_path"), F.lower("code_snippet")
    suffixes = ("_test.go", "_test.py", ".test.js", ".test.ts", ".spec.js", ".spec.ts")
    test = reduce(lambda a, b: a | b, [path.endswith(x) for x in suffixes]) | _any(path, ("/tests/", "/test/", "/spec/"))
    example = _any(path, ("/examples/", "/example/", "/demo/", "/demos/"))
    t = F.trim(code)
    return findings.withColumns({
        "is_test_file": test,
        "in_comment": t.startswith("//") | t.startswith("#") | t.startswith("/*") | t.startswith("*"),
        "variable_name_contains_test": _any(code, ("test", "mock", "fake", "stub", "example")),
        "in_example_code": example,
        "in_deprecated_block": _any(code, ("deprecated", "todo:remove", "todo: remove")),
        "high_severity_rule": F.col("severity").isin(0, 1),
        "in_dependency_signal": F.col("in_dependency"),
        "called_in_production_path": ~test & ~example & ~_any(path, ("/testdata/", "/fixtures/", "/vendor/")) & (path != ""),
    })


def posterior(findings: DataFrame, priors: DataFrame | None = None, default: float = 0.70, threshold: float = 0.50) -> DataFrame:
    """``findings`` with ``posterior`` and ``real``; ``priors`` are rows (rule_id, prior). [I1, H13]

    Signals that are absent count by their complements. The 16 likelihood ratios
    are constants, so the posterior is one expression.
    """
    df = signals(findings)
    prior = F.lit(default)
    if priors is not None:
        df = df.join(F.broadcast(priors), "rule_id", "left")
        prior = F.coalesce("prior", F.lit(default))
    odds = F.when(prior <= 0, F.lit(float("-inf"))).when(prior >= 1, F.lit(float("inf"))).otherwise(F.ln(prior / (1 - prior)))
    for name, p, q in SIGNALS:
        odds = odds + F.when(F.col(name), F.lit(math.log(p / q))).otherwise(F.lit(math.log((1 - p) / (1 - q))))
    return df.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("real", F.col("posterior") >= threshold)


def false_positive_rate(assessed: DataFrame) -> DataFrame:
    """Share of findings taken for false alarms. [D18]"""
    return assessed.agg(F.round(F.avg((~F.col("real")).cast("double")), 9).alias("fp_rate"))


def beta_update(feedback: DataFrame, default: float = 0.70, strength: float = 2.0) -> DataFrame:
    """Posterior mean per rule after feedback (rule_id, real), from a weak prior. [D26]

    Single updates commute, so counts are enough.
    """
    out = feedback.groupBy("rule_id").agg((F.count_if("real") + default * strength).alias("alpha"), (F.count_if(~F.col("real")) + (1 - default) * strength).alias("beta"))
    return out.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
