"""Queries on parsed code, reachability, roles, keys and workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherlake.operators import access as A, calls as C, workflow as W
from cipherlake.sources import code_calls as S, samples
from cipherlake.sources.bridge import table

NOW = "2024-02-01"


def go(s):
    return S.go_code(samples.files(s).where("language = 'go'"))


def python(s):
    return S.python_code(samples.files(s).where("language = 'python'"))


def transitions(s, d):
    """Events as workflow requests: one finding per user, the wanted status by event value."""
    e = table(s, d, "events")
    names = F.array(*[F.lit(x) for x in W.STATUSES])
    return e.select(F.col("user_id").alias("finding_id"), "ts", F.col("event_id").alias("id"), F.element_at(names, F.pmod(F.col("value").cast("int"), F.lit(len(W.STATUSES))).cast("int") + 1).alias("to_status"))


def opened(s, d):
    return table(s, d, "events").groupBy(F.col("user_id").alias("finding_id")).agg(F.min("ts").alias("created_at"), F.pmod(F.min("event_id"), F.lit(4)).cast("int").alias("severity"))


_STATUS = "[" + ", ".join(f"'{x}'" for x in W.STATUSES) + "]"
_VALID = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in W.TRANSITIONS) + ") AS v(from_status, to_status)"
_STATES = f"""WITH RECURSIVE r AS (SELECT user_id AS finding_id, ts, {_STATUS}[CAST(floor(value) AS INT) % {len(W.STATUSES)} + 1] AS want, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
v AS (SELECT * FROM {_VALID}), o AS (SELECT user_id AS finding_id, min(ts) AS created_at, CAST(min(event_id) % 4 AS INT) AS severity FROM events GROUP BY 1),
w(finding_id, n, status, updated_at, moves) AS (SELECT finding_id, CAST(0 AS BIGINT), 'new', created_at, 0 FROM o
  UNION ALL SELECT w.finding_id, r.n, CASE WHEN v.to_status IS NOT NULL THEN r.want ELSE w.status END, CASE WHEN v.to_status IS NOT NULL THEN r.ts ELSE w.updated_at END, w.moves + CASE WHEN v.to_status IS NOT NULL THEN 1 ELSE 0 END
  FROM w JOIN r ON r.finding_id = w.finding_id AND r.n = w.n + 1 LEFT JOIN v ON v.from_status = w.status AND v.to_status = r.want),
s AS (SELECT finding_id, arg_max(status, n) AS status, arg_max(updated_at, n) AS updated_at, arg_max(moves, n) AS moves FROM w GROUP BY finding_id),
d AS (SELECT s.*, created_at, severity, created_at + to_days(CASE severity WHEN 0 THEN 14 WHEN 1 THEN 30 WHEN 2 THEN 90 ELSE 180 END) AS deadline FROM s JOIN o USING (finding_id))"""


def states(s, d):
    return W.fold(opened(s, d), transitions(s, d))


#: Lines of the Python sample and the rules' table; calls and values by regular expressions.
_PY = (
    "WITH p AS (SELECT string_split('" + samples.FILES["/app/sign.py"][1].replace("'", "''") + "', chr(10)) AS ls), l AS (SELECT CAST(i AS INT) AS line_no, ls[i] AS line FROM p, unnest(range(1, len(ls) + 1)) AS r(i) WHERE NOT starts_with(ls[i], '#')), "
    "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}', '{r[0]}', {r[1]}, {r[2]}, {r[3]}, '{r[4]}')" for i, (fs, *r) in enumerate(C.PYTHON_CALLS) for f in fs) + ") AS v(rule, name, algorithm, severity, quantum_threat, category, rule_id)), "
    "calls AS (SELECT line_no, regexp_extract(line, '([A-Za-z_][\\w.]*)\\(', 1) AS name, regexp_extract(line, '\\((.*)\\)', 1) AS args, coalesce(TRY_CAST(regexp_extract(line, 'key_size=(\\d+)', 1) AS INT), 0) AS key_size FROM l), "
    "vars AS (SELECT regexp_extract(line, '^(\\w+) = ', 1) AS variable, upper(arg_max(regexp_extract(line, '^\\w+ = \"([^\"]*)\"$', 1), line_no)) AS value FROM l GROUP BY 1) "
    "SELECT '/app/sign.py' AS path, line_no, rule_id, CASE WHEN contains(args, 'SECP384R1') THEN 'ECDSA-P384' WHEN contains(args, 'SECP256R1') THEN 'ECDSA-P256' WHEN key_size > 0 THEN algorithm || '-' || key_size ELSE algorithm END AS algorithm, severity, quantum_threat, category, key_size, CAST(0.93 AS DOUBLE) AS confidence "
    "FROM calls JOIN rules r ON r.name = calls.name WHERE rule = (SELECT min(rule) FROM rules x WHERE x.name = calls.name) "
    "UNION ALL SELECT '/app/sign.py', line_no, 'QS-PY-TAINT-001', value, 1, 1, 4, 0, CAST(0.85 AS DOUBLE) FROM calls JOIN vars ON split_part(args, ',', 1) = variable WHERE name = 'hashlib.new' AND value IN ('MD5', 'SHA1', 'SHA-1')"
)

QUERIES = {
    "q_go_calls": (lambda s, d: C.go_findings(go(s)).select("path", "line_no", "rule_id", "algorithm", "severity", "quantum_threat", "category", "key_size"), None),  # no SQL: tests hold these three to answers worked out by hand
    "q_go_tls": (lambda s, d: C.tls_configurations(go(s)), None),
    "q_py_calls": (lambda s, d: C.python_findings(python(s)), _PY),
    "q_taint": (lambda s, d: C.taint(go(s)), None),
    "q_taint_reach": (
        lambda s, d: A.reach(A.supply_edges(s, d), A.supply_start(s, d), depth=3),
        "WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey), r(node, hops) AS (SELECT 0, 0 UNION SELECT b, hops + 1 FROM r JOIN e ON a = node WHERE hops < 3) SELECT node, CAST(min(hops) AS INT) AS hops, round(pow(CAST(0.95 AS DOUBLE), min(hops)), 9) AS confidence FROM r GROUP BY node",
    ),
    "q_role_permissions": (
        lambda s, d: A.permitted(s, table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.element_at(F.array(*[F.lit(r) for r in A.ROLES]), F.pmod("c_custkey", F.lit(len(A.ROLES))).cast("int") + 1).alias("role")), "finding:write").groupBy("role").agg(F.count("*").alias("n")),
        "SELECT role, count(*) AS n FROM (SELECT ['" + "', '".join(A.ROLES) + f"'][c_custkey % {len(A.ROLES)} + 1] AS role FROM customer) WHERE role IN (" + ", ".join(f"'{r}'" for r, ps in A.PERMISSIONS if "finding:write" in ps) + ") GROUP BY role",
    ),
    "q_api_key_hash": (
        lambda s, d: A.hashed_keys(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("key_"), F.col("c_name")).alias("plaintext"))),
        "SELECT c_custkey AS id, sha256('key_' || c_name) AS key_hash, left('key_' || c_name, 10) || '...' AS prefix FROM customer",
    ),
    "q_org_keys": (
        lambda s, d: A.without_key(A.keys_of(A.hashed_keys(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("key_"), F.col("c_name")).alias("plaintext"))).join(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("org-"), F.col("c_nationkey").cast("string")).alias("org_id")), "id"), "org-3"), 7).select("id", "prefix", "org_id"),
        "SELECT c_custkey AS id, left('key_' || c_name, 10) || '...' AS prefix, 'org-' || c_nationkey AS org_id FROM customer WHERE c_nationkey = 3 AND c_custkey <> 7",
    ),
    "q_workflow_state": (lambda s, d: states(s, d).select("finding_id", "status", "updated_at", "moves"), f"{_STATES} SELECT finding_id, status, updated_at, moves FROM s"),
    "q_sla_breach": (lambda s, d: W.breaches(W.with_deadline(states(s, d)), NOW).select("finding_id", "status", "deadline"), f"{_STATES} SELECT finding_id, status, deadline FROM d WHERE status NOT IN ('fixed', 'verified', 'wont_fix', 'false_positive') AND CAST('{NOW}' AS TIMESTAMP) > deadline"),
    "q_progress": (
        lambda s, d: W.progress(W.with_deadline(states(s, d)), NOW),
        f"{_STATES} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'fixed') AS fixed, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status IN ('in_progress', 'in_review')) AS in_progress, count(*) FILTER (WHERE status NOT IN ('fixed', 'verified')) AS remaining, round(count(*) FILTER (WHERE status IN ('fixed', 'verified')) / CAST(count(*) AS DOUBLE) * 100, 6) AS progress_pct, round(coalesce(avg(epoch(updated_at - created_at) / 3600) FILTER (WHERE status IN ('fixed', 'verified')), 0), 4) AS mean_fix_hours, count(*) FILTER (WHERE status NOT IN ('fixed', 'verified', 'wont_fix', 'false_positive') AND CAST('{NOW}' AS TIMESTAMP) > deadline) AS sla_breaches FROM d",
    ),
}
