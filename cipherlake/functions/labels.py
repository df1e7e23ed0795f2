"""Ordinals and their labels, the migration and algorithm dimensions, and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
CATEGORIES = ("Asymmetric Encryption", "Digital Signature", "Key Exchange", "Symmetric Encryption", "Hashing", "Key Derivation", "TLS Cipher Suite", "Certificate", "SSH", "KMS")
THREATS = ("Shor", "Grover", "Safe")
#: Category ordinals by the names that rule tables use.
CATEGORY_ORDINALS = {
    "AsymmetricEncryption": 0, "DigitalSignature": 1, "KeyExchange": 2, "SymmetricEncryption": 3, "Hashing": 4, "KeyDerivation": 5, "TLSCipherSuite": 6, "Certificate": 7, "SSH": 8, "KMS": 9,
    "asymmetric_encryption": 0, "digital_signature": 1, "key_exchange": 2, "symmetric_encryption": 3, "hashing": 4, "tls_cipher_suite": 6, "certificate": 7, "ssh": 8,
}

# Fixed values: (algorithm, replacement, hybrid, effort, priority).
MIGRATIONS = (
    ("RSA-1024", "ML-KEM-512", "RSA-3072 + ML-KEM-512", "medium", "critical"),
    ("RSA-2048", "ML-KEM-768", "RSA-3072 + ML-KEM-768", "medium", "critical"),
    ("RSA-3072", "ML-KEM-768", "RSA-3072 + ML-KEM-768", "medium", "high"),
    ("RSA-4096", "ML-KEM-1024", "RSA-4096 + ML-KEM-1024", "medium", "high"),
    ("ECDSA-P256", "ML-DSA-44", "ECDSA-P256 + ML-DSA-44", "medium", "critical"),
    ("ECDSA-P384", "ML-DSA-65", "ECDSA-P384 + ML-DSA-65", "medium", "critical"),
    ("ECDSA-P521", "ML-DSA-87", "ECDSA-P521 + ML-DSA-87", "medium", "high"),
    ("Ed25519", "ML-DSA-44", "Ed25519 + ML-DSA-44", "low", "high"),
    ("ECDH-P256", "ML-KEM-768", "X25519 + ML-KEM-768", "medium", "critical"),
    ("ECDH-X25519", "ML-KEM-768", "X25519 + ML-KEM-768", "low", "high"),
    ("DH-2048", "ML-KEM-768", "", "high", "critical"),
    ("DSA", "ML-DSA-44", "", "low", "critical"),
    ("AES-128", "AES-256", "", "low", "medium"),
    ("3DES", "AES-256", "", "low", "high"),
    ("Blowfish", "AES-256", "", "low", "high"),
    ("RC4", "AES-256-GCM", "", "low", "critical"),
    ("MD5", "SHA-256", "", "low", "high"),
    ("SHA-1", "SHA-256", "", "low", "high"),
)

# Fixed values: (name, type, key size, classical bits, quantum bits, quantum safe, replacement).
ALGORITHMS = (
    ("RSA-2048", "asymmetric", 2048, 112, 0, False, "ML-KEM-768"),
    ("RSA-4096", "asymmetric", 4096, 140, 0, False, "ML-KEM-1024"),
    ("ECDSA-P256", "signature", 256, 128, 0, False, "ML-DSA-44"),
    ("ECDH-P256", "key_exchange", 256, 128, 0, False, "ML-KEM-768"),
    ("AES-128", "symmetric", 128, 128, 64, False, "AES-256"),
    ("AES-256", "symmetric", 256, 256, 128, True, ""),
)


def label(values: tuple[str, ...], ordinal: Column, unknown: str) -> Column:
    """The label of an ordinal; ``unknown`` outside the list or for null."""
    out = F.when(ordinal == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(ordinal == i, v)
    return out.otherwise(unknown)


def severity_label(c: Column) -> Column:
    return label(SEVERITIES, c, "UNKNOWN")


def category_label(c: Column) -> Column:
    return label(CATEGORIES, c, "Unknown")


def threat_label(c: Column) -> Column:
    return label(THREATS, c, "Unknown")


def migrations(spark: SparkSession) -> DataFrame:
    """18 rows; always small enough to broadcast."""
    return spark.createDataFrame(MIGRATIONS, "algorithm string, replacement string, hybrid string, effort string, priority string")


def algorithms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALGORITHMS, "name string, type string, key_size int, classical_bits int, quantum_bits int, quantum_safe boolean, replacement string")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(\.[^./]*)$", 1)


def repository_path(path: Column) -> Column:
    """Without a leading ``./``, then without a leading ``/``."""
    return F.regexp_replace(F.regexp_replace(path, r"^\./", ""), "^/", "")


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin(0, 1), "error").when(severity == 2, "warning").otherwise("note")


def annotation_level(severity: Column) -> Column:
    return F.when(severity.isin(0, 1), "failure").when(severity == 2, "warning").otherwise("notice")


def diagnostic(severity: Column) -> Column:
    return F.when(severity <= 1, "error").when(severity == 2, "warning").otherwise("info")


#: Word boundary of ASCII words, which java.util.regex and RE2 read alike.
BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def portable_regex(pattern: str) -> str:
    """An RE2 pattern for java.util.regex: ASCII word boundaries, Unicode case folding."""
    return pattern.replace("(?i)", "(?iu)").replace(r"\b", BOUNDARY)
