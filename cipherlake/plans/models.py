"""Queries of the Bayesian, Markov, harvest and timing models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cipherlake.models import bayes as B, markov as K, optimal as O
from cipherlake.operators import relational as R
from cipherlake.plans.relational import SCANS
from cipherlake.sources.bridge import F_CTE, findings, table

START = 2026


def _r(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_PATH, _CODE = "lower(file_path)", "lower(code_snippet)"
_has = lambda c, *parts: "(" + " OR ".join(f"contains({c}, '{p}')" for p in parts) + ")"
_SIG = {
    "is_test_file": "(" + " OR ".join(f"ends_with({_PATH}, '{x}')" for x in ("_test.go", "_test.py", ".test.js", ".test.ts", ".spec.js", ".spec.ts")) + f" OR {_has(_PATH, '/tests/', '/test/', '/spec/')})",
    "in_comment": f"regexp_matches(trim({_CODE}), '^(//|#|/\\*|\\*)')",
    "variable_name_contains_test": _has(_CODE, "test", "mock", "fake", "stub", "example"),
    "in_example_code": _has(_PATH, "/examples/", "/example/", "/demo/", "/demos/"),
    "in_deprecated_block": _has(_CODE, "deprecated", "todo:remove", "todo: remove"),
    "high_severity_rule": "severity IN (0, 1)",
    "in_dependency_signal": "in_dependency",
    "called_in_production_path": f"NOT {_has(_PATH, '/tests/', '/test/', '/spec/', '/examples/', '/example/', '/demo/', '/demos/', '/testdata/', '/fixtures/', '/vendor/')} AND file_path <> ''",
}
_S = "s AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _SIG.items()) + " FROM f)"
_ODDS = f"ln(CAST(0.7 AS DOUBLE) / (1 - CAST(0.7 AS DOUBLE))) + " + " + ".join(f"CASE WHEN {n} THEN CAST({math.log(p / q)!r} AS DOUBLE) ELSE CAST({math.log((1 - p) / (1 - q))!r} AS DOUBLE) END" for n, p, q in B.SIGNALS)
_POST = f"WITH {F_CTE}, {_S}, o AS (SELECT *, 1 / (1 + exp(-({_ODDS}))) AS posterior FROM s)"


def feedback(s, d):
    labels = table(s, d, "labels")
    return labels.select(F.concat(F.lit("R-"), F.pmod("doc_id", F.lit(8)).cast("string")).alias("rule_id"), (F.col("quality") == 1).alias("real"))


def commits(s, d):
    """Events as commits: the user is the author, the event type the action."""
    e = table(s, d, "events")
    action = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    return e.select(F.col("user_id").alias("author"), "ts", F.col("event_id").alias("id"), action.alias("action"))


_COMMITS = "c AS (SELECT user_id AS author, ts, event_id AS id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS action FROM events)"
_MOVES = """m AS (SELECT author, action AS to_state, lag(action) OVER (PARTITION BY author ORDER BY ts, id) AS from_state FROM c),
n AS (SELECT author, from_state, to_state, count(*) AS n FROM m WHERE from_state IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT author, CAST(a AS INT) AS from_state, CAST(b AS INT) AS to_state FROM (SELECT DISTINCT author FROM c), range(4) AS x(a), range(4) AS y(b)),
p AS (SELECT author, from_state, to_state, (coalesce(n, 0) + CAST(0.01 AS DOUBLE)) / sum(coalesce(n, 0) + CAST(0.01 AS DOUBLE)) OVER (PARTITION BY author, from_state) AS p FROM g LEFT JOIN n USING (author, from_state, to_state))"""
_PROFILE = f"""WITH {_COMMITS}, {_MOVES},
b AS (SELECT author, count(*) AS commits, avg(CAST(action = 0 AS INT)) AS share_0, avg(CAST(action = 1 AS INT)) AS share_1, arg_max(action, (ts, id)) AS last_action FROM c GROUP BY author HAVING count(*) >= 10),
x AS (SELECT b.author, commits, last_action, least(greatest(100 * (share_0 - share_1 + 1) / 2, 0), 100) AS risk, arg_max(to_state, (p, -to_state)) AS next_action, max(p) AS next_p FROM b JOIN p ON p.author = b.author AND p.from_state = b.last_action GROUP BY ALL)"""

_STATES = f"WITH {F_CTE}, {SCANS}, t AS (SELECT scan_id, started, readiness, CASE WHEN readiness >= 95 THEN 4 WHEN readiness >= 70 THEN 3 WHEN readiness >= 40 THEN 2 WHEN readiness >= 10 THEN 1 ELSE 0 END AS state FROM scans)"

_PQ = "1 / (1 + exp(-CAST(0.5 AS DOUBLE) * (h.year + 1 - 2032)))"


def _chain(parameters):
    return f"""h(id, harvest, value, stop, year, s0, s1, s2, s3, s4, pq) AS (
  SELECT id, harvest, value, stop, year, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM {parameters}
  UNION ALL SELECT id, harvest, value, stop, year + 1, s0 * (1 - harvest), s0 * harvest + s1 * (1 - {_PQ}), s1 * {_PQ} + s2 * (1 - {_PQ}), s2 * {_PQ} + s3 * (1 - value), s3 * value + s4, {_PQ} FROM h WHERE year < stop)"""


_SUMMARY = """g AS (SELECT *, s4 - lag(s4) OVER (PARTITION BY id ORDER BY year) AS gain FROM h),
z AS (SELECT id, max(s4) AS peak, CAST(round(sum(year * gain) FILTER (WHERE gain > 0) / sum(gain) FILTER (WHERE gain > 0)) AS INT) AS expected_year, sum(s4) / (max(year) - min(year)) AS mean_risk FROM g GROUP BY id),
y AS (SELECT *, CASE WHEN peak >= 0.7 THEN 'CRITICAL' WHEN peak >= 0.4 THEN 'HIGH' WHEN peak >= 0.15 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM z)"""


def default_parameters(s):
    return s.createDataFrame([("default", 0.15, 1.0, 0.8, 0.5, 2032.0, START, 2040)], "id string, harvest double, vulnerability double, value double, steepness double, midpoint double, start int, end int")


_CURVE = f"""WITH {F_CTE}, a AS (SELECT count(*) AS n, CASE WHEN avg(CAST(quantum_threat = 0 AS INT)) = 0 THEN 0.1 ELSE avg(CAST(quantum_threat = 0 AS INT)) END AS share FROM f),
q AS (SELECT CAST(CAST('2026-01-01' AS DATE) + to_months(CAST(3 * i AS INT)) AS DATE) AS quarter FROM range(401) AS r(i) WHERE CAST('2026-01-01' AS DATE) + to_months(CAST(3 * i AS INT)) < CAST('2033-01-01' AS DATE)),
k AS (SELECT quarter, sum(1 / (1 + exp(-CAST(0.5 AS DOUBLE) * (y - 2032))) * share * CAST(0.15 AS DOUBLE) * 5000000 * pow(CAST(0.95 AS DOUBLE), y - 2026)) AS risk FROM q, a, range(2026, 2034) AS r(y) WHERE y <= year(quarter) GROUP BY quarter),
c AS (SELECT quarter, CAST(100000 AS DOUBLE) / (1 + CAST(0.15 AS DOUBLE) * ((quarter - CAST('2026-01-01' AS DATE)) * 24 / CAST(8766 AS DOUBLE))) AS migration, risk, 2 * CAST(150 AS DOUBLE) * n * 4 * (1 + CASE WHEN (CAST('2033-01-01' AS DATE) - quarter) * 24 / CAST(8766 AS DOUBLE) < 1 THEN CAST(0.5 AS DOUBLE) ELSE 0 END) * CAST(0.1 AS DOUBLE) AS opportunity FROM k, a)"""

QUERIES = {
    "q_bayes_signals": (
        lambda s, d: B.signals(findings(s, d)).groupBy(*_SIG).agg(F.count("*").alias("n")),
        f"WITH {F_CTE}, {_S} SELECT {', '.join(_SIG)}, count(*) AS n FROM s GROUP BY ALL",
    ),
    "q_bayes_posterior": (
        lambda s, d: _r(B.posterior(findings(s, d)), "posterior").groupBy("rule_id", "posterior", "real").agg(F.count("*").alias("n")),
        f"{_POST} SELECT rule_id, round(posterior, 9) AS posterior, posterior >= 0.5 AS real, count(*) AS n FROM o GROUP BY ALL",
    ),
    "q_bayes_ranked": (
        lambda s, d: _r(B.posterior(findings(s, d)), "posterior").orderBy(F.desc("posterior"), "l_orderkey", "l_suppkey", "l_extendedprice", "line_start").select("posterior", "l_orderkey", "l_suppkey", "line_start"),
        f"{_POST} SELECT round(posterior, 9) AS posterior, l_orderkey, l_suppkey, line_start FROM o ORDER BY round(posterior, 9) DESC, l_orderkey, l_suppkey, l_extendedprice, line_start",
    ),
    "q_fp_rate": (lambda s, d: B.false_positive_rate(B.posterior(findings(s, d))), f"{_POST} SELECT round(avg(CAST(posterior < 0.5 AS INT)), 9) AS fp_rate FROM o"),
    "q_beta_update": (
        lambda s, d: _r(B.beta_update(feedback(s, d)), "alpha", "beta", "mean"),
        "WITH c AS (SELECT 'R-' || (doc_id % 8) AS rule_id, count(*) FILTER (WHERE quality = 1) + 2 * CAST(0.7 AS DOUBLE) AS alpha, count(*) FILTER (WHERE quality <> 1) + 2 * (1 - CAST(0.7 AS DOUBLE)) AS beta FROM labels GROUP BY 1) SELECT rule_id, round(alpha, 9) AS alpha, round(beta, 9) AS beta, round(alpha / (alpha + beta), 9) AS mean FROM c",
    ),
    "q_bayes_feedback_posterior": (
        lambda s, d: B.false_positive_rate(B.posterior(findings(s, d), B.beta_update(feedback(s, d)).select("rule_id", F.col("mean").alias("prior")))),
        f"WITH {F_CTE}, {_S}, c AS (SELECT 'R-' || (doc_id % 8) AS rid, count(*) FILTER (WHERE quality = 1) + 2 * CAST(0.7 AS DOUBLE) AS a, count(*) FILTER (WHERE quality <> 1) + 2 * (1 - CAST(0.7 AS DOUBLE)) AS b FROM labels GROUP BY 1), o AS (SELECT 1 / (1 + exp(-({_ODDS.replace('ln(CAST(0.7 AS DOUBLE) / (1 - CAST(0.7 AS DOUBLE)))', 'ln(coalesce(a / (a + b), 0.7) / (1 - coalesce(a / (a + b), 0.7)))')}))) AS posterior FROM s LEFT JOIN c ON rid = rule_id) SELECT round(avg(CAST(posterior < 0.5 AS INT)), 9) AS fp_rate FROM o",
    ),
    "q_markov_states": (lambda s, d: K.states(R.scans(findings(s, d))).select("scan_id", "readiness", "state"), f"{_STATES} SELECT scan_id, readiness, state FROM t"),
    "q_markov_transitions": (
        lambda s, d: _r(K.transition_matrix(K.states(R.scans(findings(s, d))), K.STATES, [], ["started", "scan_id"], "state"), "p"),
        f"{_STATES}, m AS (SELECT state AS to_state, lag(state) OVER (ORDER BY started, scan_id) AS from_state FROM t), n AS (SELECT from_state, to_state, count(*) AS n FROM m WHERE from_state IS NOT NULL GROUP BY 1, 2), g AS (SELECT CAST(a AS INT) AS from_state, CAST(b AS INT) AS to_state FROM range(5) AS x(a), range(5) AS y(b)) SELECT from_state, to_state, round((coalesce(n, 0) + CAST(0.01 AS DOUBLE)) / sum(coalesce(n, 0) + CAST(0.01 AS DOUBLE)) OVER (PARTITION BY from_state), 9) AS p FROM g LEFT JOIN n USING (from_state, to_state)",
    ),
    "q_markov_predict": (lambda s, d: K.predict(R.scans(findings(s, d)).withColumn("project", F.year("started")), ["project"]), None),
    "q_dev_actions": (lambda s, d: _r(K.transition_matrix(commits(s, d), K.ACTIONS, ["author"], ["ts", "id"], "action"), "p"), f"WITH {_COMMITS}, {_MOVES} SELECT author, from_state, to_state, round(p, 9) AS p FROM p"),
    "q_dev_profiles": (lambda s, d: _r(K.developer_profiles(commits(s, d)), "risk").select("author", "commits", "risk", "last_action").orderBy(F.desc("risk"), "author"), f"{_PROFILE} SELECT author, commits, round(risk, 9) AS risk, last_action FROM x"),
    "q_dev_next_action": (lambda s, d: _r(K.developer_profiles(commits(s, d)), "next_p").select("author", "next_action", "next_p"), f"{_PROFILE} SELECT author, next_action, round(next_p, 9) AS next_p FROM x"),
    "q_hndl_years": (
        lambda s, d: _r(K.hndl_years(default_parameters(s)), "s0", "s1", "s2", "s3", "s4", "pq"),
        f"WITH RECURSIVE {_chain('(SELECT ' + chr(39) + 'default' + chr(39) + ' AS id, CAST(0.15 AS DOUBLE) AS harvest, CAST(0.8 AS DOUBLE) AS value, 2040 AS stop, 2026 AS year)')} SELECT id, year, round(s0, 9) AS s0, round(s1, 9) AS s1, round(s2, 9) AS s2, round(s3, 9) AS s3, round(s4, 9) AS s4, round(pq, 9) AS pq FROM h",
    ),
    "q_hndl_summary": (
        lambda s, d: _r(K.hndl_summary(K.hndl_years(default_parameters(s))), "peak", "mean_risk"),
        f"WITH RECURSIVE {_chain('(SELECT ' + chr(39) + 'default' + chr(39) + ' AS id, CAST(0.15 AS DOUBLE) AS harvest, CAST(0.8 AS DOUBLE) AS value, 2040 AS stop, 2026 AS year)')}, {_SUMMARY} SELECT id, round(peak, 9) AS peak, expected_year, level, round(mean_risk, 9) AS mean_risk FROM y",
    ),
    "q_hndl_findings": (
        lambda s, d: _r(K.hndl_findings(findings(s, d), START), "peak", "mean_risk").groupBy("algorithm", "level", "expected_year").agg(F.count("*").alias("n"), F.max("peak").alias("peak")),
        f"""WITH RECURSIVE {F_CTE}, w AS (SELECT DISTINCT category || '-' || severity AS id, CASE severity WHEN 0 THEN CAST(0.25 AS DOUBLE) WHEN 1 THEN CAST(0.2 AS DOUBLE) WHEN 2 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS harvest,
  CASE WHEN category IN (0, 2) THEN CAST(0.9 AS DOUBLE) WHEN category IN (1, 7) THEN CAST(0.7 AS DOUBLE) WHEN category = 3 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS value, {START + 15} AS stop, {START} AS year FROM f WHERE quantum_threat = 0), {_chain('w')}, {_SUMMARY}
SELECT algorithm, level, expected_year, count(*) AS n, max(round(peak, 9)) AS peak FROM f JOIN y ON y.id = category || '-' || severity WHERE quantum_threat = 0 GROUP BY 1, 2, 3""",
    ),
    "q_optimal_curve": (lambda s, d: _r(O.cost_curve(findings(s, d), "2026-01-01", "2033-01-01"), "migration", "risk", "opportunity", digits=4).select("quarter", "migration", "risk", "opportunity"), f"{_CURVE} SELECT quarter, round(migration, 4) AS migration, round(risk, 4) AS risk, round(opportunity, 4) AS opportunity FROM c"),
    "q_optimal_best": (
        lambda s, d: _r(O.best_quarter(O.cost_curve(findings(s, d), "2026-01-01", "2033-01-01")), "total", "delay_increase_pct", digits=4),
        f"{_CURVE}, t AS (SELECT quarter, migration + risk + opportunity AS total FROM c), b AS (SELECT arg_min(quarter, (total, quarter)) AS quarter, min(total) AS total, arg_max(total, quarter) AS last FROM t) SELECT quarter, 'Q' || quarter(quarter) || ' ' || year(quarter) AS label, round(total, 4) AS total, round((last - total) / total * 100, 4) AS delay_increase_pct FROM b",
    ),
}
