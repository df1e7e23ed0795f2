"""X.509 certificates in files and in source text: a DER reader and its findings."""

from __future__ import annotations

import base64
import binascii
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

# Object identifiers.
KEY_KINDS = {"1.2.840.113549.1.1.1": "RSA", "1.2.840.10045.2.1": "ECDSA", "1.3.101.112": "Ed25519"}
CURVES = {"1.2.840.10045.3.1.7": 256, "1.3.132.0.34": 384, "1.3.132.0.35": 521, "1.3.132.0.10": 256}
SIGNATURES = {"1.2.840.113549.1.1.5": "SHA1-RSA", "1.2.840.10045.4.1": "ECDSA-SHA1", "1.2.840.113549.1.1.11": "SHA256-RSA", "1.2.840.113549.1.1.12": "SHA384-RSA", "1.2.840.113549.1.1.13": "SHA512-RSA", "1.2.840.10045.4.3.2": "ECDSA-SHA256", "1.2.840.10045.4.3.3": "ECDSA-SHA384", "1.2.840.10045.4.3.4": "ECDSA-SHA512", "1.3.101.112": "Ed25519"}
_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]+)-----(.*?)-----END \1-----", re.S)
SCHEMA = "path string, subject string, issuer string, serial string, key_algo string, key_size int, signature string, not_before timestamp, not_after timestamp, dns_names array<string>, is_ca boolean"


def _items(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the elements of a DER sequence's content."""
    out, i = [], 0
    while i < len(data):
        tag, n, i = data[i], data[i + 1], i + 2
        if n & 128:
            k = n & 127
            n, i = int.from_bytes(data[i : i + k], "big"), i + k
        if i + n > len(data):
            raise ValueError("element longer than its parent")
        out.append((tag, data[i : i + n]))
        i += n
    return out


def _oid(data: bytes) -> str:
    parts, value = [], 0
    for b in data:
        value = value << 7 | b & 127
        if not b & 128:
            parts.append(value)
            value = 0
    first = min(parts[0] // 40, 2)
    return ".".join(map(str, [first, parts[0] - 40 * first, *parts[1:]]))


def _time(tag: int, data: bytes) -> datetime:
    text = data.decode().rstrip("Z")
    if tag == 23:
        text = ("19" if int(text[:2]) >= 50 else "20") + text
    return datetime.strptime(text[:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)


def _common_name(data: bytes) -> str:
    for _, group in _items(data):
        for _, pair in _items(group):
            (_, oid), (_, value) = _items(pair)[:2]
            if _oid(oid) == "2.5.4.3":
                return value.decode("utf-8", "replace")
    return ""


def read_certificate(der: bytes) -> tuple:
    """Fields of one certificate, as in ``SCHEMA`` after the path."""
    (_, body), (_, signature) = _items(_items(der)[0][1])[:2]
    fields = _items(body)
    if fields[0][0] == 0xA0:
        fields = fields[1:]
    serial, _, issuer, validity, subject, spki = (f[1] for f in fields[:6])
    (algorithm, key) = (f[1] for f in _items(spki)[:2])
    ids = _items(algorithm)
    kind = KEY_KINDS.get(_oid(ids[0][1]), "unknown")
    size = 0
    if kind == "RSA":
        size = int.from_bytes(_items(_items(key[1:])[0][1])[0][1], "big").bit_length()
    elif kind == "ECDSA" and len(ids) > 1 and ids[1][0] == 6:
        size = CURVES.get(_oid(ids[1][1]), 0)
    elif kind == "Ed25519":
        size = 256
    names, ca = [], False
    for tag, content in fields[6:]:
        if tag == 0xA3:
            for _, extension in _items(_items(content)[0][1]):
                parts = _items(extension)
                oid = _oid(parts[0][1])
                if oid == "2.5.29.17":
                    names = [v.decode("ascii", "replace") for t, v in _items(_items(parts[-1][1])[0][1]) if t == 0x82]
                elif oid == "2.5.29.19":
                    basic = _items(_items(parts[-1][1])[0][1])
                    ca = bool(basic) and basic[0][0] == 1 and basic[0][1] != b"\0"
    start, end = (_time(*t) for t in _items(validity))
    method = _oid(_items(signature)[0][1])
    return _common_name(subject), _common_name(issuer), str(int.from_bytes(serial, "big", signed=True)), kind, size, SIGNATURES.get(method, method), start, end, names, ca


def read_certificates(data: bytes) -> list[tuple]:
    """All certificates of a file: PEM blocks, or the whole as DER if there are none; unreadable ones are passed over."""
    blocks = [(m[1], m[2]) for m in _PEM.finditer(data)]
    if blocks:
        ders = []
        for kind, text in blocks:
            if kind == b"CERTIFICATE":
                try:
                    ders.append(base64.b64decode(b"".join(text.split()), validate=True))
                except binascii.Error:
                    continue
    else:
        ders = [data]
    out = []
    for der in ders:
        try:
            out.append(read_certificate(der))
        except (ValueError, IndexError, UnicodeDecodeError):
            continue
    return out


def certificates(files: DataFrame) -> DataFrame:
    """One row per certificate of rows (path, content binary). [A5, A6, A7, A8]"""
    import pandas as pd

    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, *c) for p, d in zip(pdf["path"], pdf["content"]) for c in read_certificates(bytes(d or b""))], columns=names)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def certificate_findings(certs: DataFrame) -> DataFrame:
    """Key and signature findings, effort, and whether the certificate outlives 2030. [B16]"""
    vulnerable = F.col("key_algo").isin("RSA", "ECDSA", "Ed25519")
    name = F.when(F.col("key_algo") == "RSA", F.concat(F.lit("RSA-"), F.col("key_size").cast("string"))).when(F.col("key_algo") == "ECDSA", F.concat(F.lit("ECDSA-P"), F.col("key_size").cast("string"))).otherwise(F.col("key_algo"))
    effort = F.when(F.col("is_ca"), "high").when(F.size("dns_names") > 3, "medium").otherwise("low")
    late = vulnerable & (F.year("not_after") > 2030)
    keys = certs.where(vulnerable).select("path", F.lit("CERT-PQC-001").alias("rule_id"), F.lit(0).alias("severity"), F.lit(0).alias("quantum_threat"), name.alias("algorithm"), "key_size", effort.alias("migration_effort"), late.alias("late"))
    sha1 = certs.where(F.col("signature").isin("SHA1-RSA", "ECDSA-SHA1")).select("path", F.lit("CERT-HASH-001").alias("rule_id"), F.lit(1).alias("severity"), F.lit(1).alias("quantum_threat"), F.col("signature").alias("algorithm"), F.lit(0).alias("key_size"), F.lit("low").alias("migration_effort"), F.lit(False).alias("late"))
    return keys.unionByName(sha1)
