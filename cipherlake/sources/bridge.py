"""Deterministic findings, scans and signals over the benchmark tables.

The tables hold no findings, so each relational operator runs over a projection
of ``lineitem``, ``part`` and ``orders``. The SQL is common to Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FINDINGS_SQL = """
SELECT concat('scan-', CAST(year(o_orderdate) AS STRING), '-', CAST(month(o_orderdate) AS STRING)) AS scan_id,
  CAST(o_orderdate AS DATE) AS scan_date,
  concat(CASE WHEN p_size % 5 = 0 THEN '/tests/f' ELSE '/src/f' END, CAST(l_orderkey % 500 AS STRING), '.go') AS file_path,
  l_linenumber AS line_start,
  concat('R-', CAST(p_size % 8 AS STRING)) AS rule_id,
  (l_linenumber - 1) % 4 AS severity,
  p_size % 10 AS category,
  CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS quantum_threat,
  CASE p_size % 8 WHEN 0 THEN 'RSA-2048' WHEN 1 THEN 'ECDSA-P256' WHEN 2 THEN 'ECDH-X25519' WHEN 3 THEN 'AES-128'
    WHEN 4 THEN '3DES' WHEN 5 THEN 'MD5' WHEN 6 THEN 'TLS 1.0' ELSE 'SHA-1' END AS algorithm,
  CASE p_size % 8 WHEN 0 THEN 2048 WHEN 1 THEN 256 WHEN 3 THEN 128 ELSE 0 END AS key_size,
  CASE p_size % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'java' ELSE 'javascript' END AS language,
  CASE p_size % 6 WHEN 0 THEN 'provides encryption' WHEN 1 THEN 'signature check' WHEN 2 THEN 'ssh-rsa host key' ELSE 'usage' END AS description,
  CASE l_linenumber % 5 WHEN 0 THEN '// deprecated call' WHEN 1 THEN 'mockKey := newKey()' WHEN 2 THEN 'rsa.GenerateKey(rand.Reader, 2048)' ELSE 'h := sum(data)' END AS code_snippet,
  CAST(0.80 AS DOUBLE) + l_discount AS confidence,
  l_linenumber % 2 = 0 AS auto_fix,
  l_linestatus = 'F' AS in_dependency,
  l_shipdate AS created_at,
  l_orderkey, l_suppkey, l_quantity, l_extendedprice
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FINDINGS_SQL, **{t: table(spark, sf_dir, t) for t in ("lineitem", "part", "orders")})


#: The same relation as a DuckDB common table expression ``f``.
F_CTE = "f AS (" + FINDINGS_SQL.format(lineitem="lineitem", part="part", orders="orders") + ")"
