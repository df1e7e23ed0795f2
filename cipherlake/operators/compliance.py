"""Compliance of findings with five frameworks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Keyword lists, matched as upper-cased substrings.
KEYWORDS = {
    "kem": ("RSA", "ECDH", "DH", "Diffie-Hellman", "ECDHE", "X25519", "X448", "Curve25519"),
    "sig": ("RSA", "ECDSA", "Ed25519", "Ed448", "DSA"),
    "hash": ("MD5", "SHA1", "SHA-1", "SHA-128"),
    "sym": ("DES", "3DES", "RC4", "Blowfish", "AES-128"),
    "tls": ("TLS 1.0", "TLS 1.1", "SSL"),
    "ssh": ("ssh-rsa", "ecdsa-sha2", "ssh-dss"),
}

# Fixed values: (framework, requirement, deadline, what is counted, status when the count is above 0).
REQUIREMENTS = (
    ("CNSA 2.0", "CNSA2-KEM-01", "2027-01-01", ("kem", 2), "non-compliant"),
    ("CNSA 2.0", "CNSA2-SIG-01", "2027-01-01", ("sig", 1), "non-compliant"),
    ("CNSA 2.0", "CNSA2-HASH-01", "2027-01-01", ("hash",), "non-compliant"),
    ("CNSA 2.0", "CNSA2-SYM-01", "2027-01-01", ("sym",), "non-compliant"),
    ("CNSA 2.0", "CNSA2-TLS-01", "2027-01-01", ("tls", 6), "non-compliant"),
    ("CNSA 2.0", "CNSA2-CERT-01", "2028-01-01", (7,), "non-compliant"),
    ("CNSA 2.0", "CNSA2-SSH-01", "2029-01-01", ("ssh", 8), "non-compliant"),
    ("CNSA 2.0", "CNSA2-LEGACY-01", "2033-01-01", ("shor",), "in-progress"),
    ("NSM-10", "NSM10-INV-01", "2025-12-31", (), "compliant"),
    ("NSM-10", "NSM10-PLAN-01", "2025-12-31", ("shor",), "in-progress"),
    ("NSM-10", "NSM10-PRIORITY-01", "2025-12-31", ("shor",), "non-compliant"),
    ("NSM-10", "NSM10-MONITOR-01", "2025-12-31", (), "compliant"),
    ("EU PQC", "EUPQC-ASSESS-01", "2026-06-30", (), "compliant"),
    ("EU PQC", "EUPQC-AGILITY-01", "2027-12-31", ("shor",), "non-compliant"),
    ("EU PQC", "EUPQC-HYBRID-01", "2027-12-31", (6, 2), "non-compliant"),
    ("EU PQC", "EUPQC-DATA-01", "2026-12-31", ("shor",), "non-compliant"),
    ("PCI DSS 4.0", "PCIDSS-CRYPTO-01", "2025-03-31", ("sym", "hash"), "non-compliant"),
    ("PCI DSS 4.0", "PCIDSS-TLS-01", "2025-03-31", ("tls",), "non-compliant"),
    ("PCI DSS 4.0", "PCIDSS-KEYS-01", "2025-03-31", (9,), "non-compliant"),
    ("PCI DSS 4.0", "PCIDSS-INV-01", "2025-03-31", (), "compliant"),
    ("HIPAA", "HIPAA-ENC-01", "2026-12-31", ("sym", "hash"), "non-compliant"),
    ("HIPAA", "HIPAA-ENC-02", "2026-12-31", ("tls", 6), "non-compliant"),
    ("HIPAA", "HIPAA-KEY-01", "2026-12-31", (9,), "non-compliant"),
)
FRAMEWORKS = tuple(dict.fromkeys(r[0] for r in REQUIREMENTS))


def framework_name(c: Column) -> Column:
    """The framework that a user's spelling names; null for others. [H10]"""
    key = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]", "")
    pairs = (("cnsa2", 0), ("cnsa20", 0), ("cnsa", 0), ("nsm10", 1), ("eupqc", 2), ("eu", 2), ("pcidss", 3), ("pcidss40", 3), ("pci", 3), ("hipaa", 4))
    return F.coalesce(*[F.when(key == k, F.lit(FRAMEWORKS[i])) for k, i in pairs])


def _matches(keywords: tuple[str, ...]) -> Column:
    text = F.upper(F.concat_ws(" ", "algorithm", "description", "code_snippet"))
    return reduce(lambda a, b: a | b, [text.contains(k.upper()) for k in keywords])


def _counted(of) -> Column:
    if of == "shor":
        return F.count_if(F.col("quantum_threat") == 0)
    return F.count_if(F.col("category") == of) if isinstance(of, int) else F.count_if(_matches(KEYWORDS[of]))


def requirements(findings: DataFrame, framework: str | None = None) -> DataFrame:
    """One row per requirement: blocking findings and status. [D4 to D10, G4]

    One aggregation over the findings counts what all requirements need; a
    finding counts once per list or category that a requirement names.
    """
    wanted = [r for r in REQUIREMENTS if framework in (None, r[0])]
    parts = sorted({p for r in wanted for p in r[3]}, key=str)
    counts = findings.agg(F.count("*").alias("total"), *[_counted(p).alias(f"n_{p}") for p in parts])
    blocking = lambda r: reduce(lambda a, b: a + b, [F.col(f"n_{p}") for p in r[3]], F.lit(0).cast("long"))
    rows = F.explode(F.array(*[F.struct(F.lit(r[0]).alias("framework"), F.lit(r[1]).alias("requirement"), F.lit(r[2]).cast("date").alias("deadline"), blocking(r).alias("blocking"), F.lit(r[4]).alias("status_if")) for r in wanted]))
    out = counts.select("total", rows.alias("r")).select("r.framework", "r.requirement", "r.deadline", "r.blocking", F.col("total"), F.col("r.status_if"))
    return out.select("framework", "requirement", "deadline", "blocking", "total", F.when(F.col("blocking") > 0, F.col("status_if")).otherwise("compliant").alias("status"))


def reports(findings: DataFrame) -> DataFrame:
    """One row per framework: share of compliant requirements, overall status, blocking findings. [D11]"""
    pct = F.count_if(F.col("status") == "compliant") / F.count("*") * 100
    out = requirements(findings).groupBy("framework").agg(pct.alias("pct"), F.sum("blocking").alias("blocking"), F.max("total").alias("total"))
    overall = F.when(F.col("pct") == 100, "compliant").when(F.col("pct") >= 50, "partially-compliant").otherwise("non-compliant")
    return out.select("framework", F.round("pct", 6).alias("compliance_pct"), "blocking", "total", overall.alias("overall"))
