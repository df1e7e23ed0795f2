"""Sequences of API calls under two hidden Markov models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from cipherlake.functions.labels import portable_regex

# Call patterns in the order of their symbols; symbol 21 is any other call.
CALLS = (
    r"rsa\.GenerateKey",
    r"rsa\.EncryptPKCS1v15|rsa\.EncryptOAEP",
    r"rsa\.DecryptPKCS1v15|rsa\.DecryptOAEP",
    r"rsa\.SignPKCS1v15|rsa\.SignPSS",
    r"ecdsa\.GenerateKey",
    r"ecdsa\.Sign",
    r"ecdsa\.Verify",
    r"ecdh\.GenerateKey|elliptic\.GenerateKey",
    r"ecdh\.ECDH|elliptic\.Marshal",
    r"aes\.NewCipher",
    r"cipher\.NewGCM",
    r"cipher\.NewCBCEncrypter|cipher\.NewCBCDecrypter",
    r"cipher\.NewCFBEncrypter|cipher\.NewCFBDecrypter",
    r"cipher\.NewCTR",
    r"sha256\.New|sha256\.Sum256",
    r"sha512\.New|sha512\.Sum512",
    r"sha3\.New|sha3\.Sum256|sha3\.Sum512",
    r"hmac\.New",
    r"mlkem\.Encapsulate|mlkem\.Decapsulate|kem\.Encapsulate",
    r"mldsa\.Sign|dilithium\.Sign",
    r"mldsa\.Verify|dilithium\.Verify",
)
SYMBOLS = 22
SECURE, INSECURE, NEUTRAL = range(3)

# Initial and transition probabilities by state (secure, insecure, neutral), and emissions above the uniform.
INSECURE_MODEL = (
    (0.1, 0.7, 0.2),
    ((0.6, 0.2, 0.2), (0.1, 0.7, 0.2), (0.2, 0.3, 0.5)),
    ({18: 0.15, 19: 0.10, 20: 0.10, 10: 0.10}, {0: 0.12, 1: 0.10, 2: 0.08, 3: 0.08, 4: 0.08, 5: 0.08, 6: 0.04, 7: 0.06, 8: 0.05, 9: 0.08, 11: 0.10, 12: 0.10}, {14: 0.15, 15: 0.10, 16: 0.10, 17: 0.15, 21: 0.10}),
)
SECURE_MODEL = (
    (0.7, 0.1, 0.2),
    ((0.8, 0.05, 0.15), (0.3, 0.4, 0.3), (0.3, 0.2, 0.5)),
    ({18: 0.20, 19: 0.15, 20: 0.12, 10: 0.18, 9: 0.08, 16: 0.08, 11: 0.01, 12: 0.01}, {0: 0.10, 1: 0.08, 5: 0.06, 8: 0.06, 9: 0.10, 11: 0.12, 12: 0.12}, {14: 0.15, 15: 0.10, 17: 0.15, 21: 0.15}),
)


def parameters(model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(initial, transition, emission); emission rows are uniform but for the given symbols, then normalised. [I11]"""
    start, moves, given = model
    emission = np.full((3, SYMBOLS), 1 / SYMBOLS)
    for row, values in zip(emission, given):
        for k, v in values.items():
            row[k] = v
    return np.array(start), np.array(moves), emission / emission.sum(1, keepdims=True)


def viterbi(model, seen) -> tuple[list[int], float]:
    """The likeliest states and their log probability; the first of equals wins. [I12]"""
    start, moves, emission = parameters(model)
    with np.errstate(divide="ignore"):
        log = np.log(start) + np.log(emission[:, seen[0]])
        a = np.log(moves)
        back = []
        for o in seen[1:]:
            options = log[:, None] + a
            back.append(options.argmax(0))
            log = options.max(0) + np.log(emission[:, o])
    path = [int(log.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(log.max())


def forward(model, seen) -> float:
    """Log-likelihood of a sequence. [I13]"""
    start, moves, emission = parameters(model)
    with np.errstate(divide="ignore"):
        log = np.log(start) + np.log(emission[:, seen[0]])
        a = np.log(moves)
        for o in seen[1:]:
            log = np.logaddexp.reduce(log[:, None] + a, 0) + np.log(emission[:, o])
        return float(np.logaddexp.reduce(log))


def api_calls(lines: DataFrame) -> DataFrame:
    """(path, line_no, symbol, nth, name): every match of every pattern, by line, pattern and place. [B25]"""

    def matches(symbol, pattern):
        return F.transform(F.regexp_extract_all("line", F.lit(f"({portable_regex(pattern)})")), lambda m, n: F.struct(F.lit(symbol).alias("symbol"), n.alias("nth"), m.alias("name")))

    found = F.concat(*[matches(i, p) for i, p in enumerate(CALLS)])
    return lines.select("path", "line_no", F.explode(found).alias("c")).select("path", "line_no", "c.symbol", "c.nth", "c.name")


def sequences(calls: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, symbols): each key's symbols in order."""
    return calls.groupBy(F.col(key).alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "symbol"))), lambda x: x["symbol"]).alias("symbols"))


def decode(seqs: DataFrame) -> DataFrame:
    """(key, position, symbol, state, llr): states under the insecure model, log-likelihood ratio of the two."""
    import pandas as pd

    kind = seqs.schema["key"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for key, seen in zip(pdf["key"], pdf["symbols"]):
                seen = [int(o) for o in seen]
                path, _ = viterbi(INSECURE_MODEL, seen)
                yield pd.DataFrame({"key": key, "position": range(len(seen)), "symbol": seen, "state": path, "llr": forward(INSECURE_MODEL, seen) - forward(SECURE_MODEL, seen)})

    return seqs.mapInPandas(run, f"key {kind}, position int, symbol int, state int, llr double")


def runs(decoded: DataFrame) -> DataFrame:
    """Contiguous runs of the insecure state: gaps and islands. [E10]"""
    w = Window.partitionBy("key").orderBy("position")
    rows = decoded.withColumn("change", F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("state") == INSECURE)
    return rows.groupBy("key", "island").agg(F.min("position").alias("start"), (F.max("position") + 1).alias("end"), F.array_sort(F.collect_set("symbol")).alias("symbols"), F.max("llr").alias("llr"))


def patterns(decoded: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Vulnerability patterns of keys that the insecure model fits better by ``threshold``. [I14]

    A key without a run of a known kind is reported whole, as HMM-001.
    """
    has = lambda *xs: F.arrays_overlap("symbols", F.array(*[F.lit(x) for x in xs]))
    kem = has(18)
    rule = F.when(has(9) & has(11, 12) & ~has(10), "HMM-003").when(has(0, 1, 2, 3) & ~kem, "HMM-002").when(has(4, 5, 6, 7, 8) & ~kem, "HMM-004").when(has(17) & has(14) & ~has(16), "HMM-005")
    label = F.when(F.col("rule_id") == "HMM-003", "AES-CFB/CBC").when(F.col("rule_id") == "HMM-002", "RSA").when((F.col("rule_id") == "HMM-004") & has(7, 8), "ECDH").when(F.col("rule_id") == "HMM-004", "ECDSA").otherwise("HMAC-SHA256")
    bad = decoded.where(F.col("llr") >= threshold)
    found = runs(bad).withColumn("rule_id", rule).where("rule_id is not null").withColumn("algorithm", label).select("key", "start", "end", "rule_id", "algorithm", "llr")
    whole = bad.groupBy("key").agg(F.lit(0).alias("start"), (F.max("position") + 1).alias("end"), F.max("llr").alias("llr")).join(found, "key", "left_anti")
    return found.unionByName(whole.select("key", "start", "end", F.lit("HMM-001").alias("rule_id"), F.lit("mixed").alias("algorithm"), "llr"))
