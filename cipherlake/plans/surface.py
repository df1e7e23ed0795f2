"""Queries on sinks, calibration, the orchestrator and small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherlake.functions.labels import basename, extension, repository_path
from cipherlake.models import analysis as N
from cipherlake.operators import compliance as C
from cipherlake.plans.graphs import _MC, items
from cipherlake.sources import certificates as X, sinks as K
from cipherlake.sources.bridge import F_CTE, findings
from cipherlake.sources.files import language_of
from cipherlake.sources.sample_certificates import PEM

PATHS = ["/a/b/main.go", "./src/x.PY", "/etc/ssh/sshd_config", "noext", "/w/app.test.ts", "/c/d.e/f", "deploy.yaml"]
NAMES = ["cnsa2", "CNSA 2.0", "nsm-10", "EU PQC", "pci-dss", "HIPAA", "other"]



def certs(s):
    return X.certificates(s.createDataFrame([(p, bytearray(t.encode())) for p, t in PEM.items()], "path string, content binary"))


QUERIES = {
    "q_paths": (
        lambda s, d: s.createDataFrame([(p,) for p in PATHS], "path string").select("path", basename(F.col("path")).alias("base"), extension(F.col("path")).alias("ext"), repository_path(F.col("path")).alias("repository"), language_of(F.col("path")).alias("language")),
        "SELECT path, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext, regexp_replace(regexp_replace(path, '^\\./', ''), '^/', '') AS repository, CASE WHEN ends_with(path, '.go') THEN 'go' WHEN ends_with(path, '.ts') THEN 'javascript' WHEN ends_with(path, '.yaml') OR ends_with(path, 'sshd_config') THEN 'config' END AS language FROM (VALUES " + ", ".join(f"('{p}')" for p in PATHS) + ") AS v(path)",
    ),
    "q_framework_names": (
        lambda s, d: s.createDataFrame([(n,) for n in NAMES], "name string").select("name", C.framework_name(F.col("name")).alias("framework")),
        "SELECT name, CASE regexp_replace(lower(trim(name)), '[^a-z0-9]', '', 'g') WHEN 'cnsa2' THEN 'CNSA 2.0' WHEN 'cnsa20' THEN 'CNSA 2.0' WHEN 'nsm10' THEN 'NSM-10' WHEN 'eupqc' THEN 'EU PQC' WHEN 'pcidss' THEN 'PCI DSS 4.0' WHEN 'hipaa' THEN 'HIPAA' END AS framework FROM (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ") AS v(name)",
    ),
    "q_sarif_runs": (
        lambda s, d: K.sarif(findings(s, d)).select("rule_id", F.size(F.from_json("run", "results array<struct<ruleId:string>>")["results"]).alias("n")).groupBy("rule_id").agg(F.sum("n").alias("results")),
        f"WITH {F_CTE} SELECT rule_id, count(*) AS results FROM f GROUP BY rule_id",
    ),
    "q_finding_json": (
        lambda s, d: K.finding_json(findings(s, d)).select(F.get_json_object("json", "$.threat_label").alias("threat"), F.get_json_object("json", "$.severity_label").alias("severity")).groupBy("threat", "severity").agg(F.count("*").alias("n")),
        f"WITH {F_CTE} SELECT CASE quantum_threat WHEN 0 THEN 'Shor' WHEN 1 THEN 'Grover' ELSE 'Safe' END AS threat, CASE severity WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, count(*) AS n FROM f GROUP BY ALL",
    ),
    "q_cert_parse": (
        lambda s, d: certs(s).select("path", "subject", "issuer", "serial", "key_algo", "key_size", "signature", F.col("not_before").cast("date").alias("not_before"), F.col("not_after").cast("date").alias("not_after"), F.array_join("dns_names", ",").alias("dns_names"), "is_ca"),
        # as another tool prints these certificates
        "SELECT path, subject, subject AS issuer, serial, key_algo, key_size, signature, CAST('2026-11-26' AS DATE) AS not_before, CAST(not_after AS DATE) AS not_after, dns_names, is_ca FROM (VALUES "
        "('/certs/rsa.pem', 'rsa.example.org', '73195721104385322474137439068995450694731323797', 'RSA', 2048, 'SHA256-RSA', '2036-11-23', 'a.example.org,b.example.org,c.example.org,d.example.org', true), "
        "('/certs/ec.pem', 'ec.example.org', '339164213878417637453287406533375213208056983062', 'ECDSA', 384, 'ECDSA-SHA256', '2027-11-26', '', false), "
        "('/certs/ed.pem', 'ed.example.org', '405621391952862827678954212635240334288610155152', 'Ed25519', 256, 'Ed25519', '2027-11-26', '', true)) AS v(path, subject, serial, key_algo, key_size, signature, not_after, dns_names, is_ca)",
    ),
    "q_cert_findings": (
        lambda s, d: X.certificate_findings(certs(s)),
        "SELECT path, 'CERT-PQC-001' AS rule_id, 0 AS severity, 0 AS quantum_threat, algorithm, key_size, migration_effort, late FROM (VALUES ('/certs/rsa.pem', 'RSA-2048', 2048, 'high', true), ('/certs/ec.pem', 'ECDSA-P384', 384, 'low', false), ('/certs/ed.pem', 'Ed25519', 256, 'high', false)) AS v(path, algorithm, key_size, migration_effort, late)",
    ),
    "q_calibration": (
        lambda s, d: N.calibrate(findings(s, d), items(s, d)).withColumn("error", F.round("error", 6)),
        f"{_MC} SELECT 'markov' AS model, round(1 - least(1 - exp(-(count(DISTINCT scan_id) - 1) / CAST(10 AS DOUBLE)), 0.99), 6) AS error FROM f UNION ALL SELECT 'simulation', round(abs(s - e) / e, 6) FROM (SELECT avg(hours) AS s FROM si), (SELECT sum(CASE WHEN in_dependency OR auto_fix THEN exp(CAST(0.545 AS DOUBLE)) ELSE exp(CAST(6 AS DOUBLE)) END) AS e FROM it)",
    ),
    "q_analyze": (lambda s, d: N.overview(findings(s, d), items(s, d)), None),
}
