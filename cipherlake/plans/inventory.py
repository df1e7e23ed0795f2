"""Queries on compliance, bills of materials, certificates, keys, endpoints and dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherlake.operators import compliance as C, inventory as I
from cipherlake.sources import manifests as M
from cipherlake.sources.bridge import F_CTE, findings, table
from cipherlake.sources.files import cloud_keys, tls_probes

NOW = "2026-01-01"
# Written for these queries: captured handshakes and described keys.
HANDSHAKES = [
    ("a:443", "CONNECTED(3)\nsubject=CN = a.example.org, O = A \nissuer=CN = Example CA\nPeer signing digest: SHA256\nPeer signature type: RSA-PSS\nServer public key is 2048 bit\n    Protocol  : TLSv1.2\n    Cipher    : ECDHE-RSA-AES128-GCM-SHA256\n"),
    ("b:443", "subject=/CN=b\r\nServer public key is 256 bit\nProtocol: TLSv1.3\nCipher: TLS_AES_256_GCM_SHA384\n"),
    ("c:443", "connect: refused\n"),
]
DESCRIBED = [
    ("aws", '{"KeyMetadata":{"KeyId":"k-1","KeyState":"Enabled","KeyUsage":"SIGN_VERIFY","KeySpec":"RSA_2048","CreationDate":1700000000}}'),
    ("aws", '{"KeyMetadata":{"KeyId":"k-2","KeyState":"Disabled","KeyUsage":"ENCRYPT_DECRYPT","KeySpec":"","CustomerMasterKeySpec":"SYMMETRIC_DEFAULT"}}'),
    ("gcp", '{"name":"projects/p/k","purpose":"ASYMMETRIC_SIGN","versionTemplate":{"algorithm":"EC_SIGN_P256_SHA256"}}'),
    ("azure", '{"key":{"kid":"https://v/keys/e","kty":"EC","crv":"P-384","key_ops":["sign","verify"]}}'),
    ("azure", '{"key":{"kid":"https://v/keys/r","kty":"RSA","key_ops":["wrapKey"]}}'),
]


def _kw(name):
    text = "upper(algorithm || ' ' || description || ' ' || code_snippet)"
    return "count(*) FILTER (WHERE " + " OR ".join(f"contains({text}, '{k.upper()}')" for k in C.KEYWORDS[name]) + ")"


def _req_sql(framework=None):
    n = lambda p: "count(*) FILTER (WHERE quantum_threat = 0)" if p == "shor" else f"count(*) FILTER (WHERE category = {p})" if isinstance(p, int) else _kw(p)
    rows = [f"SELECT '{r[0]}' AS framework, '{r[1]}' AS requirement, CAST('{r[2]}' AS DATE) AS deadline, CAST({' + '.join(map(n, r[3])) or '0'} AS BIGINT) AS blocking, count(*) AS total, '{r[4]}' AS s FROM f" for r in C.REQUIREMENTS if framework in (None, r[0])]
    return f"WITH {F_CTE}, r AS ({' UNION ALL '.join(rows)}) SELECT framework, requirement, deadline, blocking, total, CASE WHEN blocking > 0 THEN s ELSE 'compliant' END AS status FROM r"


_COMPONENTS = f"""WITH {F_CTE}, g AS (
  SELECT algorithm, count(*) AS occurrences, coalesce(arg_min(key_size, (file_path, line_start, rule_id, severity, quantum_threat, language)) FILTER (WHERE key_size > 0), 0) AS size,
    min((file_path, line_start, rule_id, severity, quantum_threat, language)) AS first FROM f GROUP BY algorithm),
p AS (SELECT *, CASE WHEN contains(algorithm, 'RSA') THEN 'pke' WHEN contains(algorithm, 'ECDSA') THEN 'sig' WHEN contains(algorithm, 'ECDH') THEN 'kem' WHEN contains(algorithm, 'AES') THEN 'ae'
  WHEN algorithm IN ('DES', '3DES') THEN 'ae' WHEN algorithm IN ('MD5', 'SHA-1') THEN 'hash' WHEN contains(algorithm, 'TLS') THEN 'kex' ELSE 'other' END AS primitive FROM g),
c AS (SELECT algorithm, primitive,
  CASE primitive WHEN 'pke' THEN CASE WHEN size > 0 THEN CAST(size AS VARCHAR) ELSE '' END WHEN 'sig' THEN CASE WHEN contains(algorithm, 'P384') THEN 'P-384' WHEN contains(algorithm, 'P256') THEN 'P-256' ELSE '' END
    WHEN 'kem' THEN CASE WHEN contains(algorithm, 'X25519') THEN 'X25519' ELSE '' END WHEN 'ae' THEN CASE WHEN NOT contains(algorithm, 'AES') THEN '' WHEN contains(algorithm, '128') THEN '128' ELSE '256' END ELSE '' END AS parameter,
  CAST(CASE primitive WHEN 'pke' THEN CASE WHEN size >= 4096 THEN 140 WHEN size >= 3072 THEN 128 ELSE 112 END WHEN 'sig' THEN CASE WHEN contains(algorithm, 'P384') THEN 192 ELSE 128 END WHEN 'kem' THEN 128
    WHEN 'ae' THEN CASE WHEN algorithm = '3DES' THEN 112 WHEN algorithm = 'DES' THEN 56 WHEN contains(algorithm, '128') THEN 128 ELSE 256 END WHEN 'kex' THEN 128 ELSE 0 END AS INT) AS classical_bits,
  CAST(CASE WHEN contains(algorithm, 'AES') AND primitive = 'ae' THEN CASE WHEN contains(algorithm, '128') THEN 64 ELSE 128 END ELSE 0 END AS INT) AS quantum_bits,
  CASE {' '.join(f"WHEN contains(algorithm, '{k}') THEN '{v}'" for k, v in I.OIDS)} ELSE '' END AS oid, occurrences, first FROM p)"""

# Inputs written for these queries.
KEYS = [("k1", "RSA_2048"), ("k2", "ECC_NIST_P256"), ("k3", "SYMMETRIC_DEFAULT"), ("k4", "HMAC_SHA_256"), ("k5", "EC-P-256"), ("k6", "aes-256"), ("k7", "HMAC_SHA_224"), ("k8", "ec_sign_p384_sha384"), ("k9", "")]
ENDPOINTS = [("a:443", "ECDHE-RSA-AES128-GCM-SHA256", "TLSv1.2"), ("b:443", "TLS_AES_256_GCM_SHA384", "TLSv1.3"), ("c:443", "DHE-DSS-AES256-SHA", "TLSv1"), ("d:8443", "ECDHE-ECDSA-CHACHA20", "TLSv1.2"), ("e:443", "tls_aes_128", "TLSv1.1"), ("f:443", "AES256-SHA", "SSLv3")]
GO_MOD = "module example.org/app\n\ngo 1.22\n\nrequire github.com/one/a v1.0.0\n\nrequire (\n\tgithub.com/dgrijalva/jwt-go v3.2.0\n\tgolang.org/x/crypto v0.9.0 // indirect\n\t// a comment\n\n\tgolang.org/x/crypto/ssh v0.1.0\n)\nrequire golang.org/x/net v0.2.0 // indirect\n"
REQUIREMENTS = "# pinned\n-r base.txt\n\npycryptodome==3.18.0\ncryptography[ssh]>=41.0\nparamiko~=3.1\nflask\nrequests[socks]\nnumpy<2\nx!=1.0\n  pyopenssl === 23.0 \n"
PACKAGE_JSON = '{"name":"app","dependencies":{"node-forge":"^1.3.0","express":"4.18.2","jsonwebtoken":"9.0.0"},"devDependencies":{"jest":"29.0.0","crypto-js":"4.1.1"}}'
POM = "<project><dependencies>\n<dependency>\n <groupId>org.bouncycastle</groupId>\n <artifactId>bcprov-jdk15on</artifactId>\n <version>1.70</version>\n</dependency>\n<dependency><groupId>junit</groupId><artifactId>junit</artifactId><version>4.13</version><scope>test</scope></dependency>\n</dependencies></project>"


def _files(s, *names):
    rows = {"go.mod": GO_MOD, "requirements.txt": REQUIREMENTS, "package.json": PACKAGE_JSON, "pom.xml": POM}
    return s.createDataFrame([(f"/app/{n}", rows[n]) for n in names], "path string, content string")


def _q(text):
    return "'" + text.replace("'", "''") + "'"


def _text(text):
    return _q(text).replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '")


def _values(rows):
    return "(VALUES " + ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


def certificates(s, d):
    """Certificates from orders: expiry 25 to 37 years after the order, algorithm by status."""
    o = table(s, d, "orders")
    algo = F.when(F.col("o_orderstatus") == "F", "RSA").when(F.col("o_orderstatus") == "O", "ECDSA").otherwise("ML-DSA")
    return o.select("o_orderkey", algo.alias("key_algo"), F.date_add(F.col("o_orderdate").cast("date"), F.lit(9125) + F.pmod("o_orderkey", F.lit(12)).cast("int") * 365).alias("not_after"), (F.pmod("o_orderkey", F.lit(50)) == 0).alias("is_ca"))


_CERTS = f"""certs AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'RSA' WHEN 'O' THEN 'ECDSA' ELSE 'ML-DSA' END AS key_algo,
  CAST(o_orderdate AS DATE) + CAST(9125 + (o_orderkey % 12) * 365 AS INT) AS not_after, o_orderkey % 50 = 0 AS is_ca FROM orders),
risked AS (SELECT *, CAST(not_after - CAST('{NOW}' AS DATE) AS INT) AS days_to_expiry, key_algo IN ('RSA', 'ECDSA', 'Ed25519') AS vulnerable FROM certs),
tiers AS (SELECT *, CASE WHEN is_ca THEN 'critical' WHEN NOT vulnerable THEN 'safe' WHEN days_to_expiry < 0 THEN 'low' WHEN year(not_after) <= 2027 THEN 'medium' WHEN year(not_after) <= 2030 THEN 'high' ELSE 'critical' END AS risk FROM risked)"""

_TLS = f"""t AS (SELECT *, upper(cipher_suite) AS su FROM {_values(ENDPOINTS)} AS t(endpoint, cipher_suite, tls_version)),
k AS (SELECT *, CASE WHEN contains(su, 'RSA') THEN 'RSA' WHEN contains(su, 'ECDHE') THEN 'ECDHE' WHEN contains(su, 'DHE') THEN 'DHE' ELSE 'unknown' END AS key_exchange FROM t)"""
_KMS = f"""k AS (SELECT *, upper(spec) AS su FROM {_values(KEYS)} AS t(key_id, spec)),
c AS (SELECT key_id, spec, contains(su, 'RSA') OR contains(su, 'ECC') OR contains(su, 'EC_') OR contains(su, 'ECDSA') OR contains(su, 'SECP') AS vulnerable,
  contains(su, 'HMAC_SHA_256') OR contains(su, 'HMAC_SHA_384') OR contains(su, 'HMAC_SHA_512') OR contains(su, 'SYMMETRIC') OR contains(su, 'AES') AS ok FROM k)"""
_LINES = "l AS (SELECT no, trim(replace(replace(x, chr(9), ' '), chr(13), ' ')) AS line FROM (SELECT unnest(string_split({text}, chr(10))) AS x, generate_subscripts(string_split({text}, chr(10)), 1) AS no))"
_GOMOD = f"""{_LINES.format(text=_q(GO_MOD).replace(chr(10), "' || chr(10) || '").replace(chr(9), "' || chr(9) || '"))},
b AS (SELECT *, coalesce(last_value(CASE WHEN starts_with(line, 'require (') OR starts_with(line, 'require(') THEN 1 WHEN line = ')' THEN 0 END IGNORE NULLS) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside, regexp_split_to_array(line, ' +') AS w FROM l)"""
_REQS = f"""{_LINES.format(text=_q(REQUIREMENTS).replace(chr(10), "' || chr(10) || '"))},
o AS (SELECT *, CASE {' '.join(f"WHEN position('{o}' IN line) > 1 THEN '{o}'" for o in M.OPERATORS)} END AS op FROM l WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '-')),
n AS (SELECT CASE WHEN op IS NULL THEN line ELSE trim(substr(line, 1, position(op IN line) - 1)) END AS name, CASE WHEN op IS NULL THEN '' ELSE trim(substr(line, position(op IN line) + length(op))) END AS version FROM o)"""
_JSON = _q(PACKAGE_JSON)


QUERIES = {
    **{f"q_compliance_{n}": ((lambda s, d, fw=fw: C.requirements(findings(s, d), fw)), _req_sql(fw)) for n, fw in zip(("cnsa2", "nsm10", "eupqc", "pcidss", "hipaa"), C.FRAMEWORKS)},
    "q_compliance_all": (
        lambda s, d: C.reports(findings(s, d)),
        f"SELECT framework, round(pct, 6) AS compliance_pct, CAST(blocking AS BIGINT) AS blocking, total, CASE WHEN pct = 100 THEN 'compliant' WHEN pct >= 50 THEN 'partially-compliant' ELSE 'non-compliant' END AS overall FROM (SELECT framework, count(*) FILTER (WHERE status = 'compliant') / CAST(count(*) AS DOUBLE) * 100 AS pct, sum(blocking) AS blocking, max(total) AS total FROM ({_req_sql()}) GROUP BY framework)",
    ),
    "q_cbom_components": (lambda s, d: I.components(findings(s, d)).drop("first"), f"{_COMPONENTS} SELECT algorithm, primitive, parameter, classical_bits, quantum_bits, oid, occurrences, quantum_bits = 0 AS vulnerable FROM c"),
    "q_cbom_vulns": (
        lambda s, d: I.vulnerabilities(findings(s, d)),
        f"{_COMPONENTS} SELECT first[3] AS id, algorithm || ' is vulnerable to quantum attack' AS description, CASE first[4] WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'critical' END AS rating FROM c WHERE first[5] = 0",
    ),
    "q_cbom_csv": (
        lambda s, d: I.components_csv(findings(s, d)),
        f"""{_COMPONENTS} SELECT '"' || algorithm || '","algorithm","' || primitive || '","' || parameter || '",' || classical_bits || ',' || quantum_bits || ',"' || oid || '",' || occurrences || ',' || (quantum_bits = 0) AS line FROM c""",
    ),
    "q_cert_risk": (lambda s, d: I.certificate_risk(certificates(s, d), NOW), f"WITH {_CERTS} SELECT * FROM tiers"),
    "q_cert_expiring": (lambda s, d: I.expiring(I.certificate_risk(certificates(s, d), NOW), 90).select("o_orderkey", "days_to_expiry", "risk"), f"WITH {_CERTS} SELECT o_orderkey, days_to_expiry, risk FROM tiers WHERE days_to_expiry BETWEEN 0 AND 90"),
    "q_cert_critical": (lambda s, d: I.certificate_risk(certificates(s, d), NOW).groupBy("risk", "vulnerable").agg(F.count("*").alias("n")), f"WITH {_CERTS} SELECT risk, vulnerable, count(*) AS n FROM tiers GROUP BY 1, 2"),
    "q_kms_classify": (
        lambda s, d: I.classify_keys(s.createDataFrame(KEYS, "key_id string, spec string")),
        f"WITH {_KMS} SELECT key_id, spec, vulnerable, CASE WHEN vulnerable THEN 'critical' WHEN ok THEN 'safe' ELSE 'unknown' END AS severity FROM c",
    ),
    "q_kms_totals": (lambda s, d: I.audit_totals(I.classify_keys(s.createDataFrame(KEYS, "key_id string, spec string"))), f"WITH {_KMS} SELECT count(*) AS audited, count(*) FILTER (WHERE vulnerable) AS vulnerable, count(*) FILTER (WHERE NOT vulnerable) AS safe FROM c"),
    "q_tls_classify": (
        lambda s, d: I.classify_tls(s.createDataFrame(ENDPOINTS, "endpoint string, cipher_suite string, tls_version string")),
        f"WITH {_TLS} SELECT endpoint, cipher_suite, tls_version, key_exchange, key_exchange <> 'unknown' AS vulnerable, CASE WHEN tls_version IN ('TLSv1', 'TLSv1.1') OR key_exchange = 'RSA' THEN 'critical' WHEN key_exchange = 'unknown' THEN 'info' ELSE 'high' END AS severity FROM k",
    ),
    "q_gomod_parse": (
        lambda s, d: M.go_mod(_files(s, "go.mod")).select("name", "version", "direct"),
        f"WITH {_GOMOD} SELECT CASE WHEN starts_with(line, 'require ') OR starts_with(line, 'module ') THEN w[2] ELSE w[1] END AS name, CASE WHEN starts_with(line, 'module ') THEN '' WHEN starts_with(line, 'require ') THEN w[3] ELSE w[2] END AS version, NOT contains(line, '// indirect') AS direct FROM b WHERE (starts_with(line, 'require ') AND NOT contains(line, '(')) OR starts_with(line, 'module ') OR (inside = 1 AND line <> '' AND line <> ')' AND NOT starts_with(line, '//') AND len(w) >= 2)",
    ),
    "q_requirements_parse": (
        lambda s, d: M.requirements_txt(_files(s, "requirements.txt")).select("name", "version"),
        f"WITH {_REQS} SELECT CASE WHEN position('[' IN name) > 1 THEN split_part(name, '[', 1) ELSE name END AS name, version FROM n",
    ),
    "q_tls_probes": (
        lambda s, d: tls_probes(s.createDataFrame(HANDSHAKES, "endpoint string, output string")),
        f"SELECT endpoint, regexp_extract(o, 'Cipher\\s*(?:is|:)\\s*(\\S+)', 1) AS cipher_suite, regexp_extract(o, 'Protocol\\s*:\\s*(\\S+)', 1) AS tls_version, TRY_CAST(regexp_extract(o, 'public key is (\\d+) bit', 1) AS INT) AS key_size, regexp_extract(o, 'signing digest: (\\S+)', 1) AS signing_digest, regexp_extract(o, 'signature type: (\\S+)', 1) AS signature, trim(regexp_extract(o, 'subject=([^\\r\\n]+)', 1)) AS subject, trim(regexp_extract(o, 'issuer=([^\\r\\n]+)', 1)) AS issuer FROM (VALUES " + ", ".join("(" + _q(e) + ", " + _text(o) + ")" for e, o in HANDSHAKES) + ") AS v(endpoint, o)",
    ),
    "q_cloud_keys": (
        lambda s, d: I.classify_keys(cloud_keys(s.createDataFrame(DESCRIBED, "provider string, json string"))).select("provider", "key_id", "spec", "usage", "state", "severity"),
        f"WITH j AS (SELECT provider, j FROM {_values(DESCRIBED)} AS v(provider, j)), k AS (SELECT provider, CASE provider WHEN 'aws' THEN j ->> '$.KeyMetadata.KeyId' WHEN 'gcp' THEN j ->> '$.name' ELSE j ->> '$.key.kid' END AS key_id, CASE provider WHEN 'aws' THEN coalesce(nullif(j ->> '$.KeyMetadata.KeySpec', ''), j ->> '$.KeyMetadata.CustomerMasterKeySpec') WHEN 'gcp' THEN j ->> '$.versionTemplate.algorithm' ELSE concat_ws('-', j ->> '$.key.kty', j ->> '$.key.crv') END AS spec, CASE provider WHEN 'aws' THEN j ->> '$.KeyMetadata.KeyUsage' WHEN 'gcp' THEN j ->> '$.purpose' ELSE array_to_string(j ->> '$.key.key_ops[*]', ',') END AS usage, CASE provider WHEN 'aws' THEN j ->> '$.KeyMetadata.KeyState' WHEN 'gcp' THEN 'ENABLED' ELSE 'Enabled' END AS state FROM j) SELECT *, CASE WHEN regexp_matches(upper(spec), 'RSA|ECC|EC_|ECDSA|SECP') THEN 'critical' WHEN regexp_matches(upper(spec), 'HMAC_SHA_(256|384|512)|SYMMETRIC|AES') THEN 'safe' ELSE 'unknown' END AS severity FROM k",
    ),
    "q_package_json": (
        lambda s, d: M.package_json(_files(s, "package.json")).select("name", "version", "direct"),
        f"WITH j AS (SELECT CAST({_JSON} AS JSON) AS c), e AS (SELECT c, 'dependencies' AS part, unnest(json_keys(c, '$.dependencies')) AS name, true AS direct FROM j UNION ALL SELECT c, 'devDependencies', unnest(json_keys(c, '$.devDependencies')), false FROM j) SELECT name, json_extract_string(c, '$.' || part || '.\"' || name || '\"') AS version, direct FROM e",
    ),
    "q_pom_xml": (
        lambda s, d: M.pom_xml(_files(s, "pom.xml")).select("name", "version", "direct"),
        f"WITH e AS (SELECT unnest(regexp_extract_all({_q(POM).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}, '(?s)<dependency>.*?</dependency>')) AS x) SELECT regexp_extract(x, '<groupId>([^<]*)', 1) || ':' || regexp_extract(x, '<artifactId>([^<]*)', 1) AS name, regexp_extract(x, '<version>([^<]*)', 1) AS version, regexp_extract(x, '<scope>([^<]*)', 1) <> 'test' AS direct FROM e",
    ),
    "q_dep_vulnerable": (
        lambda s, d: I.vulnerable_dependencies(M.dependencies(_files(s, "go.mod", "requirements.txt", "package.json", "pom.xml")).select("language", "name", "version")).select("language", "name", "version", "package", "algorithms"),
        f"WITH v AS (SELECT * FROM {_values(I.VULNERABLE_PACKAGES)} AS v(package, algorithms, replacement)), d AS (SELECT * FROM {_values([('go', 'github.com/dgrijalva/jwt-go', 'v3.2.0'), ('go', 'golang.org/x/crypto', 'v0.9.0'), ('go', 'golang.org/x/crypto/ssh', 'v0.1.0'), ('python', 'pycryptodome', '3.18.0'), ('python', 'cryptography', '41.0'), ('python', 'paramiko', '3.1'), ('python', 'flask', ''), ('python', 'pyopenssl', '23.0'), ('javascript', 'node-forge', '^1.3.0'), ('javascript', 'jsonwebtoken', '9.0.0'), ('javascript', 'crypto-js', '4.1.1'), ('java', 'org.bouncycastle:bcprov-jdk15on', '1.70'), ('java', 'junit:junit', '4.13')])} AS d(language, name, version)) SELECT language, name, version, package, algorithms FROM (SELECT *, row_number() OVER (PARTITION BY language, name ORDER BY length(package) DESC) AS k FROM d JOIN v ON starts_with(name, package)) WHERE k = 1",
    ),
}
