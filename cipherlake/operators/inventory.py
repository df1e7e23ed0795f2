"""Inventories: bill of materials, certificates, key services, TLS endpoints, dependencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values, the more specific first: (substring of the algorithm, object identifier).
OIDS = (
    ("AES-128", "2.16.840.1.101.3.4.1.6"),
    ("AES-256", "2.16.840.1.101.3.4.1.46"),
    ("AES", "2.16.840.1.101.3.4.1"),
    ("3DES", "1.2.840.113549.3.7"),
    ("ECDSA", "1.2.840.10045.2.1"),
    ("ECDH", "1.3.132.1.12"),
    ("RSA", "1.2.840.113549.1.1.1"),
    ("DES", "1.3.14.3.2.7"),
    ("SHA-1", "1.3.14.3.2.26"),
    ("MD5", "1.2.840.113549.2.5"),
)

# Fixed values: (package, algorithms, replacement).
VULNERABLE_PACKAGES = (
    ("crypto/rsa", "RSA", "ML-KEM / ML-DSA"),
    ("crypto/ecdsa", "ECDSA", "ML-DSA"),
    ("crypto/ecdh", "ECDH", "ML-KEM"),
    ("crypto/des", "DES/3DES", "AES-256"),
    ("crypto/rc4", "RC4", "AES-256-GCM"),
    ("github.com/dgrijalva/jwt-go", "RSA/ECDSA", "PQC-aware JWT library"),
    ("golang.org/x/crypto/ssh", "RSA/ECDSA", "PQC-aware SSH"),
    ("pycryptodome", "RSA/ECDSA/DES", "liboqs-python"),
    ("cryptography", "RSA/ECDSA/DH", "liboqs-python"),
    ("paramiko", "RSA/ECDSA", "PQC-aware SSH library"),
    ("pyopenssl", "RSA/ECDSA", "liboqs-python"),
    ("pyOpenSSL", "RSA/ECDSA", "liboqs-python"),
    ("node-forge", "RSA/ECDSA", "liboqs-node"),
    ("node-rsa", "RSA", "ML-KEM / ML-DSA"),
    ("crypto-js", "DES/AES-CBC", "AES-256-GCM with PQC KEM"),
    ("jsonwebtoken", "RSA/ECDSA", "PQC-aware JWT library"),
    ("org.bouncycastle", "RSA/ECDSA", "BC-PQC provider"),
)


def _chain(*cases: tuple[Column, object], default) -> Column:
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for test, value in cases[1:]:
        out = out.when(test, F.lit(value))
    return out.otherwise(F.lit(default))


def primitive(algorithm: Column) -> Column:
    """Kind of an algorithm by its name, in order of precedence. [D12]"""
    has = algorithm.contains
    return _chain((has("RSA"), "pke"), (has("ECDSA"), "sig"), (has("ECDH"), "kem"), (has("AES"), "ae"), (algorithm.isin("DES", "3DES"), "ae"), (algorithm.isin("MD5", "SHA-1"), "hash"), (has("TLS"), "kex"), default="other")


def oid(algorithm: Column) -> Column:
    return F.coalesce(*[F.when(algorithm.contains(k), F.lit(v)) for k, v in OIDS], F.lit(""))


def components(findings: DataFrame) -> DataFrame:
    """One component per algorithm with levels, identifier and occurrences. [D12]"""
    sized = F.col("key_size") > 0
    order = F.struct("file_path", "line_start", "rule_id", "severity", "quantum_threat", "language")
    grouped = findings.groupBy("algorithm").agg(F.count("*").alias("occurrences"), F.min_by(F.when(sized, F.col("key_size")), F.when(sized, order)).alias("size"), F.min(order).alias("first"))
    a, size, kind = F.col("algorithm"), F.coalesce("size", F.lit(0)), primitive(F.col("algorithm"))
    classical = (
        F.when(kind == "pke", _chain((size >= 4096, 140), (size >= 3072, 128), default=112))
        .when(kind == "sig", F.when(a.contains("P384"), 192).otherwise(128))
        .when(kind == "kem", 128)
        .when(kind == "ae", _chain((a == "3DES", 112), (a == "DES", 56), (a.contains("128"), 128), default=256))
        .when(kind == "kex", 128)
        .otherwise(0)
    )
    quantum = F.when((kind == "ae") & a.contains("AES"), F.when(a.contains("128"), 64).otherwise(128)).otherwise(0)
    parameter = (
        F.when(kind == "pke", F.when(size > 0, size.cast("string")).otherwise(""))
        .when(kind == "sig", _chain((a.contains("P384"), "P-384"), (a.contains("P256"), "P-256"), default=""))
        .when(kind == "kem", F.when(a.contains("X25519"), "X25519").otherwise(""))
        .when((kind == "ae") & a.contains("AES"), F.when(a.contains("128"), "128").otherwise("256"))
        .otherwise("")
    )
    return grouped.select("algorithm", kind.alias("primitive"), parameter.alias("parameter"), classical.cast("int").alias("classical_bits"), quantum.cast("int").alias("quantum_bits"), oid(a).alias("oid"), "occurrences", (quantum == 0).alias("vulnerable"), F.col("first"))


def vulnerabilities(findings: DataFrame) -> DataFrame:
    """Components whose first finding falls to Shor's algorithm. [D12]"""
    rating = F.when(F.col("first.severity") == 1, "high").when(F.col("first.severity") == 2, "medium").otherwise("critical")
    return components(findings).where("first.quantum_threat = 0").select(F.col("first.rule_id").alias("id"), F.concat("algorithm", F.lit(" is vulnerable to quantum attack")).alias("description"), rating.alias("rating"))


def components_csv(findings: DataFrame) -> DataFrame:
    """One quoted CSV line per component. [K6]"""
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    c = components(findings)
    return c.select(F.concat_ws(",", q(F.col("algorithm")), F.lit('"algorithm"'), q(F.col("primitive")), q(F.col("parameter")), F.col("classical_bits").cast("string"), F.col("quantum_bits").cast("string"), q(F.col("oid")), F.col("occurrences").cast("string"), F.col("vulnerable").cast("string")).alias("line"))


def certificate_risk(certs: DataFrame, now: str) -> DataFrame:
    """Risk tier of certificates (key_algo, not_after, is_ca). [B17]"""
    days = F.datediff("not_after", F.lit(now).cast("date"))
    vulnerable = F.col("key_algo").isin("RSA", "ECDSA", "Ed25519")
    year = F.year("not_after")
    risk = F.when(F.col("is_ca"), "critical").when(~vulnerable, "safe").when(days < 0, "low").when(year <= 2027, "medium").when(year <= 2030, "high").otherwise("critical")
    return certs.withColumns({"days_to_expiry": days, "vulnerable": vulnerable, "risk": risk})


def expiring(certs: DataFrame, days: int) -> DataFrame:
    """Rows of ``certificate_risk`` that expire within ``days``. [J8]"""
    return certs.where(F.col("days_to_expiry").between(0, days))


def classify_keys(keys: DataFrame) -> DataFrame:
    """Severity of managed keys by their spec. [B19]"""
    s = F.upper("spec")
    has = lambda *xs: reduce(lambda a, b: a | b, [s.contains(x) for x in xs])
    asymmetric = has("RSA") | has("ECC", "EC_", "ECDSA", "SECP")
    safe = has("HMAC_SHA_256", "HMAC_SHA_384", "HMAC_SHA_512") | has("SYMMETRIC", "AES")
    return keys.withColumns({"vulnerable": asymmetric, "severity": F.when(asymmetric, "critical").when(safe, "safe").otherwise("unknown")})


def classify_tls(endpoints: DataFrame) -> DataFrame:
    """Key exchange and severity of TLS endpoints by suite and version. [B20]

    RSA is looked for first, so an ECDHE suite with RSA signatures is RSA.
    """
    s = F.upper("cipher_suite")
    kx = F.when(s.contains("RSA"), "RSA").when(s.contains("ECDHE"), "ECDHE").when(s.contains("DHE"), "DHE").otherwise("unknown")
    old = F.col("tls_version").isin("TLSv1", "TLSv1.1")
    severity = F.when(old | (kx == "RSA"), "critical").when(kx == "unknown", "info").otherwise("high")
    return endpoints.withColumns({"key_exchange": kx, "vulnerable": kx != "unknown", "severity": severity})


def audit_totals(audited: DataFrame) -> DataFrame:
    """Audited, vulnerable and safe. [D15]"""
    return audited.agg(F.count("*").alias("audited"), F.count_if("vulnerable").alias("vulnerable"), F.count_if(~F.col("vulnerable")).alias("safe"))


def vulnerable_dependencies(dependencies: DataFrame) -> DataFrame:
    """Dependencies (name, version) that are, or begin with, a known package; the exact or longest one counts. [B18, C6]

    The package table has 17 rows: a broadcast nested loop with a prefix test.
    """
    known = F.broadcast(dependencies.sparkSession.createDataFrame(VULNERABLE_PACKAGES, "package string, algorithms string, replacement string"))
    met = dependencies.withColumn("__row", F.monotonically_increasing_id()).join(known, F.col("name").startswith(F.col("package")))
    best = Window.partitionBy("__row").orderBy(F.desc(F.length("package")))
    return met.withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__k", "__row")
