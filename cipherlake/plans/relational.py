"""Queries over findings and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherlake.functions.labels import algorithms, diagnostic, severity_label
from cipherlake.operators import relational as R
from cipherlake.sources.bridge import F_CTE, findings, table

NOW = "2001-08-01"
_TIES = "algorithm, l_suppkey, l_quantity, l_extendedprice, l_orderkey, created_at"
_KEY = ["file_path", "line_start", "rule_id", "algorithm", "confidence", "l_suppkey"]
OLD, NEW = "scan-1996-3", "scan-1996-4"


def _two(s, d):
    f = findings(s, d)
    return f.where(F.col("scan_id") == NEW), f.where(F.col("scan_id") == OLD)


def _changed(s):
    return s.range(0, 500, 7).select(F.concat(F.lit("src/f"), F.col("id").cast("string"), F.lit(".go")).alias("path"))


_SEV = "CASE severity WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'UNKNOWN' END"
_CAT = "CASE category WHEN 0 THEN 'Asymmetric Encryption' WHEN 1 THEN 'Digital Signature' WHEN 2 THEN 'Key Exchange' WHEN 3 THEN 'Symmetric Encryption' WHEN 4 THEN 'Hashing' WHEN 5 THEN 'Key Derivation' WHEN 6 THEN 'TLS Cipher Suite' WHEN 7 THEN 'Certificate' WHEN 8 THEN 'SSH' WHEN 9 THEN 'KMS' ELSE 'Unknown' END"
_THR = "CASE quantum_threat WHEN 0 THEN 'Shor' WHEN 1 THEN 'Grover' WHEN 2 THEN 'Safe' ELSE 'Unknown' END"
_RISK = "least((count(*) FILTER (WHERE quantum_threat = 0) + count(*) FILTER (WHERE quantum_threat = 1) * CAST(0.4 AS DOUBLE)) / count(*) * 100, 100)"
SCANS = f"scans AS (SELECT scan_id, count(*) AS total, round({_RISK}, 6) AS risk_score, round(100 - {_RISK}, 6) AS readiness, min(scan_date) AS started, max(scan_date) AS completed, count(*) FILTER (WHERE severity = 0) AS critical, count(*) FILTER (WHERE severity = 1) AS high, count(DISTINCT file_path) AS files FROM f GROUP BY scan_id)"
_BASE = "regexp_extract(file_path, '([^/]*)$', 1) || ':' || line_start || ':' || rule_id || ':' || algorithm"
_MON = "rule_id || ':' || file_path || ':' || line_start"


def _minus(key, a, b):
    return f"WITH {F_CTE} SELECT DISTINCT {key} AS key FROM f WHERE scan_id = '{a}' EXCEPT SELECT {key} FROM f WHERE scan_id = '{b}'"


_MIG = "(VALUES ('RSA-2048','ML-KEM-768','medium','critical'),('ECDSA-P256','ML-DSA-44','medium','critical'),('ECDH-X25519','ML-KEM-768','low','high'),('AES-128','AES-256','low','medium'),('3DES','AES-256','low','high'),('MD5','SHA-256','low','high'),('SHA-1','SHA-256','low','high')) AS m(a, replacement, effort, priority)"

QUERIES = {
    "q_dedup_findings": (
        lambda s, d: R.dedupe(findings(s, d)).select(*_KEY),
        f"WITH {F_CTE} SELECT {', '.join(_KEY)} FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line_start, rule_id ORDER BY confidence DESC, {_TIES}) AS k FROM f) WHERE k = 1",
    ),
    "q_first_per_rule": (
        lambda s, d: R.rules_of(findings(s, d)).select("rule_id", "severity", "file_path", "line_start", "l_suppkey"),
        f"WITH {F_CTE} SELECT rule_id, severity, file_path, line_start, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY severity, file_path, line_start, {_TIES}) AS k FROM f) WHERE k = 1",
    ),
    "q_report_order": (
        lambda s, d: R.report_rows(findings(s, d)).select("severity", "file_path", "line_start", "rule_id", "l_suppkey").orderBy("severity", "file_path", "line_start"),
        f"WITH {F_CTE} SELECT severity, file_path, line_start, rule_id, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line_start ORDER BY severity, rule_id, {_TIES}) AS k FROM f) WHERE k = 1 ORDER BY severity, file_path, line_start",
    ),
    "q_phase_union": (
        lambda s, d: R.phase_union({"regex": (f := findings(s, d)).where("not in_dependency and category <> 7"), "dependency": f.where("in_dependency"), "certificate": f.where("category = 7")}).groupBy("phase", "rule_id").agg(F.count("*").alias("n")),
        f"WITH {F_CTE} SELECT phase, rule_id, count(*) AS n FROM (SELECT 'regex' AS phase, rule_id FROM f WHERE NOT in_dependency AND category <> 7 UNION ALL SELECT 'dependency', rule_id FROM f WHERE in_dependency UNION ALL SELECT 'certificate', rule_id FROM f WHERE category = 7) GROUP BY phase, rule_id",
    ),
    "q_summary": (
        lambda s, d: R.summary(findings(s, d)),
        f"WITH {F_CTE} SELECT 'severity' AS kind, {_SEV} AS label, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'category', {_CAT}, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'threat', {_THR}, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM f",
    ),
    "q_risk_score": (lambda s, d: R.risk(findings(s, d), "scan_id"), f"WITH {F_CTE} SELECT scan_id, count(*) AS total, round({_RISK}, 6) AS risk_score, round(100 - {_RISK}, 6) AS readiness FROM f GROUP BY scan_id"),
    "q_files_lines": (lambda s, d: R.size_counts(findings(s, d)), f"WITH {F_CTE} SELECT count(DISTINCT file_path) AS files, count(DISTINCT (file_path, line_start)) AS lines, count(*) AS findings FROM f"),
    "q_diff_incremental_new": (lambda s, d: R.difference(*_two(s, d), "baseline"), _minus(_BASE, NEW, OLD)),
    "q_diff_incremental_fixed": (lambda s, d: R.difference(*_two(s, d)[::-1], "baseline"), _minus(_BASE, OLD, NEW)),
    "q_diff_monitor": (lambda s, d: R.difference(*_two(s, d), "monitor"), _minus(_MON, NEW, OLD)),
    "q_diff_tui_counts": (
        lambda s, d: R.diff_counts(*_two(s, d)),
        f"WITH {F_CTE}, n AS (SELECT {_MON} AS key FROM f WHERE scan_id = '{NEW}'), o AS (SELECT {_MON} AS key FROM f WHERE scan_id = '{OLD}') SELECT (SELECT count(*) FROM n WHERE key NOT IN (SELECT key FROM o)) AS new_rows, (SELECT count(DISTINCT key) FROM o WHERE key NOT IN (SELECT key FROM n)) AS fixed_keys",
    ),
    "q_pr_comments": (
        lambda s, d: R.changed_file_comments(findings(s, d), _changed(s)).select("path", "line_start", "rule_id", "l_suppkey", "l_orderkey"),
        f"WITH {F_CTE} SELECT substr(file_path, 2) AS path, line_start, rule_id, l_suppkey, l_orderkey FROM f WHERE substr(file_path, 2) IN (SELECT 'src/f' || i || '.go' FROM range(0, 500, 7) AS r(i))",
    ),
    "q_unique_files": (
        lambda s, d: R.changed_file_comments(findings(s, d), _changed(s)).agg(F.countDistinct("path").alias("files"), F.count("*").alias("comments")),
        f"WITH {F_CTE} SELECT count(DISTINCT file_path) AS files, count(*) AS comments FROM f WHERE substr(file_path, 2) IN (SELECT 'src/f' || i || '.go' FROM range(0, 500, 7) AS r(i))",
    ),
    "q_check_run": (
        lambda s, d: R.check_run(findings(s, d)),
        f"WITH {F_CTE}, c AS (SELECT count(*) FILTER (WHERE severity = 0) AS critical, count(*) FILTER (WHERE severity = 1) AS high, count(*) FILTER (WHERE severity = 2) AS medium, count(*) FILTER (WHERE severity = 3) AS low, count(*) AS total FROM f) SELECT *, CASE WHEN critical + high > 0 THEN 'failure' WHEN medium + low > 0 THEN 'neutral' ELSE 'success' END AS conclusion, CASE WHEN critical > 0 THEN critical || ' critical quantum vulnerability findings' WHEN high > 0 THEN high || ' high-severity quantum vulnerability findings' WHEN medium > 0 THEN medium || ' medium-severity findings' WHEN low > 0 THEN low || ' low-severity findings' ELSE 'No quantum-vulnerable cryptography found' END AS title FROM c",
    ),
    "q_annotations": (
        lambda s, d: R.annotations(findings(s, d)).groupBy("level", "title").agg(F.count("*").alias("n"), F.min("path").alias("first_path")),
        f"WITH {F_CTE} SELECT CASE WHEN severity IN (0, 1) THEN 'failure' WHEN severity = 2 THEN 'warning' ELSE 'notice' END AS level, 'Quantum-vulnerable: ' || algorithm AS title, count(*) AS n, min(substr(file_path, 2)) AS first_path FROM f GROUP BY 1, 2",
    ),
    "q_migration_lookup": (
        lambda s, d: R.with_migration(findings(s, d)).groupBy("algorithm", "replacement", "effort", "priority").agg(F.count("*").alias("n")),
        f"WITH {F_CTE} SELECT algorithm, replacement, effort, priority, count(*) AS n FROM f LEFT JOIN {_MIG} ON algorithm = a GROUP BY 1, 2, 3, 4",
    ),
    "q_algorithm_dim": (
        lambda s, d: findings(s, d).join(F.broadcast(algorithms(s)).withColumnRenamed("name", "algorithm").select("algorithm", "type", "quantum_bits"), "algorithm").groupBy("algorithm", "type", "quantum_bits").agg(F.count("*").alias("n")),
        f"WITH {F_CTE} SELECT algorithm, type, CAST(quantum_bits AS INT) AS quantum_bits, count(*) AS n FROM f JOIN (VALUES ('RSA-2048','asymmetric',0),('ECDSA-P256','signature',0),('AES-128','symmetric',64)) AS a(name, type, quantum_bits) ON algorithm = name GROUP BY 1, 2, 3",
    ),
    "q_scan_with_findings": (
        lambda s, d: findings(s, d).join(R.scans(findings(s, d)).select("scan_id", "total", "risk_score"), "scan_id").groupBy("scan_id", "total", "risk_score").agg(F.concat_ws(",", F.array_sort(F.collect_set("rule_id"))).alias("rules")),
        f"WITH {F_CTE}, {SCANS} SELECT s.scan_id, s.total, s.risk_score, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM f JOIN scans s ON s.scan_id = f.scan_id GROUP BY 1, 2, 3",
    ),
    "q_list_scans": (lambda s, d: R.list_scans(R.scans(findings(s, d)), 10).select("scan_id", "total", "risk_score", "files", "completed"), f"WITH {F_CTE}, {SCANS} SELECT scan_id, total, risk_score, files, completed FROM scans ORDER BY completed DESC, scan_id DESC LIMIT 10"),
    "q_history": (lambda s, d: R.scans(findings(s, d)).select("scan_id", "started", "total", "readiness").orderBy("started", "scan_id"), f"WITH {F_CTE}, {SCANS} SELECT scan_id, started, total, readiness FROM scans ORDER BY started, scan_id"),
    "q_trend": (lambda s, d: R.trend(R.scans(findings(s, d)), NOW, 365).select("scan_id", "completed", "readiness", "risk_score", "total", "critical", "high"), f"WITH {F_CTE}, {SCANS} SELECT scan_id, completed, readiness, risk_score, total, critical, high FROM scans WHERE completed >= CAST('{NOW}' AS DATE) - 365"),
    "q_findings_order": (
        lambda s, d: findings(s, d).where(F.col("scan_id") == NEW).orderBy("severity", "created_at", "l_orderkey", "l_suppkey", "l_extendedprice").select("severity", "created_at", "file_path", "l_orderkey", "l_suppkey"),
        f"WITH {F_CTE} SELECT severity, created_at, file_path, l_orderkey, l_suppkey FROM f WHERE scan_id = '{NEW}' ORDER BY severity, created_at, l_orderkey, l_suppkey, l_extendedprice",
    ),
    "q_upsert_scan": (
        lambda s, d: R.upsert((f := findings(s, d)), f.where((F.col("scan_id") == NEW) & (F.col("severity") < 2))).groupBy("scan_id").agg(F.count("*").alias("n")),
        f"WITH {F_CTE} SELECT scan_id, count(*) AS n FROM f WHERE scan_id <> '{NEW}' OR severity < 2 GROUP BY scan_id",
    ),
    "q_dashboard": (
        lambda s, d: R.dashboard(findings(s, d)),
        f"WITH {F_CTE}, c AS (SELECT count(*) FILTER (WHERE auto_fix) AS auto, count(*) FILTER (WHERE NOT auto_fix) AS manual, count(*) FILTER (WHERE severity = 0 AND quantum_threat = 0) AS critical_shor, count(*) FILTER (WHERE in_dependency) AS dependency, count(*) FILTER (WHERE category = 7) AS certificate FROM f) SELECT auto, manual, round(greatest((auto * CAST(0.5 AS DOUBLE) + manual * 4) / 40, 0.1), 6) AS p50_weeks, round(greatest((auto * CAST(1 AS DOUBLE) + manual * 8) / 40, 0.1), 6) AS p90_weeks, critical_shor, dependency, certificate FROM c",
    ),
    "q_sarif_results": (
        lambda s, d: R.sarif_results(R.dedupe(findings(s, d))),
        f"WITH {F_CTE} SELECT rule_id, CASE WHEN severity IN (0, 1) THEN 'error' WHEN severity = 2 THEN 'warning' ELSE 'note' END AS level, algorithm || ': ' || description AS message, file_path AS uri, line_start AS start_line FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line_start, rule_id ORDER BY confidence DESC, {_TIES}) AS k FROM f) WHERE k = 1",
    ),
    "q_gitlab_note": (
        lambda s, d: R.note(R.note_lines(R.dedupe(findings(s, d).where(F.col("scan_id") == NEW)))),
        f"WITH {F_CTE}, x AS (SELECT '| ' || {_SEV} || ' | `' || algorithm || '` | ' || file_path || ':' || line_start || ' |' AS line FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line_start, rule_id ORDER BY confidence DESC, {_TIES}) AS k FROM f WHERE scan_id = '{NEW}') WHERE k = 1) SELECT left(string_agg(line, chr(10) ORDER BY line), 50000) AS note FROM x",
    ),
    "q_diagnostics": (
        lambda s, d: findings(s, d).select("file_path", diagnostic(F.col("severity")).alias("level"), severity_label(F.col("severity")).alias("label")).groupBy("file_path", "level").agg(F.count("*").alias("n"), F.max("label").alias("label")),
        f"WITH {F_CTE} SELECT file_path, CASE WHEN severity <= 1 THEN 'error' WHEN severity = 2 THEN 'warning' ELSE 'info' END AS level, count(*) AS n, max({_SEV}) AS label FROM f GROUP BY 1, 2",
    ),
    "q_leaderboard": (
        lambda s, d: R.risk(findings(s, d), "language").withColumn("risk_label", F.when(F.col("readiness") < 15, "critical").when(F.col("readiness") < 30, "high").when(F.col("readiness") < 50, "elevated").when(F.col("readiness") < 70, "moderate").otherwise("low")).select("language", "total", F.round("readiness").cast("int").alias("score"), "risk_label"),
        f"WITH {F_CTE}, r AS (SELECT language, count(*) AS total, round(100 - {_RISK}, 6) AS readiness FROM f GROUP BY language) SELECT language, total, CAST(round(readiness) AS INT) AS score, CASE WHEN readiness < 15 THEN 'critical' WHEN readiness < 30 THEN 'high' WHEN readiness < 50 THEN 'elevated' WHEN readiness < 70 THEN 'moderate' ELSE 'low' END AS risk_label FROM r",
    ),
}
