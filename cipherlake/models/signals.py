"""Signals: sliding entropy, spectra and their features, content classes, traffic fingerprints."""

from __future__ import annotations

import base64
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cipherlake.models.information import PART

# Fixed values: (suite, centroid, spread, flatness, rolloff at 85 %, mean ms, deviation ms).
REFERENCES = (
    ("RSA-2048", 5.0, 3.0, 0.3, 12.0, 3.5, 1.2),
    ("ECDHE-P256", 8.0, 1.5, 0.5, 10.0, 0.7, 0.3),
    ("ML-KEM-768", 10.0, 0.8, 0.85, 11.0, 0.2, 0.05),
    ("DH-2048", 3.0, 4.0, 0.2, 14.0, 5.5, 2.0),
    ("ECDHE-P384", 7.5, 1.8, 0.45, 10.0, 1.0, 0.4),
    ("RSA-4096", 4.0, 3.5, 0.25, 13.0, 6.0, 2.5),
)
EPSILON = 1e-12


def window_entropies(x: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Entropy in bits of each window of bytes; a tail that fills no window is dropped."""
    if len(x) < size:
        return np.empty(0)
    starts = np.arange(0, len(x) - size + 1, stride)
    out = np.empty(len(starts))
    table = np.concatenate([[0.0], (np.arange(1, size + 1) / size) * np.log2(np.arange(1, size + 1) / size)])
    for i in range(0, len(starts), 1024):
        some = starts[i : i + 1024]
        codes = x[some[:, None] + np.arange(size)] + 256 * np.arange(len(some))[:, None]
        counts = np.bincount(codes.ravel(), minlength=256 * len(some)).reshape(-1, 256)
        out[i : i + 1024] = -table[counts].sum(1)
    return out


def sliding_entropy(samples: DataFrame, size: int = 256, stride: int = 64) -> DataFrame:
    """(id, position, start, entropy) of the windows of rows (id, data). [E6]"""
    import pyarrow as pa

    kind = samples.schema["id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for i in range(0, len(whole), PART):
                batch = whole.slice(i, PART)
                h = [window_entropies(np.frombuffer(d or b"", np.uint8).astype(np.int64), size, stride) for d in batch.column(1).to_pylist()]
                n = [len(v) for v in h]
                at = np.concatenate([np.arange(k) for k in n]) if n else np.empty(0, np.int64)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int64()), pa.array(at * stride, pa.int64()), pa.array(np.concatenate(h) if h else [], pa.float64())], ["id", "position", "start", "entropy"])

    return samples.select("id", "data").mapInArrow(run, f"id {kind}, position long, start long, entropy double")


def anomalies(series: DataFrame, deviations: float = 2.0) -> DataFrame:
    """Windows whose entropy is more than ``deviations`` from its sample's mean. [E7]"""
    stats = series.groupBy("id").agg(F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("sd"))
    return series.join(stats, "id").where((F.col("sd") > 0) & (F.abs(F.col("entropy") - F.col("mean")) > deviations * F.col("sd"))).withColumn("deviation", F.abs(F.col("entropy") - F.col("mean")) / F.col("sd"))


def content_class(data: bytes) -> str:
    """pem, hex, base64, binary or unknown. [H19]"""
    if b"-----BEGIN" in data or b"-----END" in data:
        return "pem"
    text = data.strip()
    if len(text) >= 32:
        hexed = text.translate(None, b" \n\r\t:")
        if len(hexed) >= 32 and len(hexed) % 2 == 0 and not hexed.translate(None, b"0123456789abcdefABCDEF"):
            return "hex"
        coded = text.translate(None, b" \n\r\t")
        letters = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="
        if len(coded) >= 32 and not coded.translate(None, letters):
            part = coded[:256]
            try:
                base64.b64decode(part + b"=" * (-len(part) % 4), validate=True)
                return "base64"
            except ValueError:
                pass
    odd = sum(c < 32 and c not in (9, 10, 13) for c in data)
    return "binary" if data and odd / len(data) > 0.1 else "unknown"


def psd(x: np.ndarray) -> np.ndarray:
    """Power by frequency bin, padded with zeros to a power of two. [I24]"""
    n = 1 << max(0, len(x) - 1).bit_length()
    return np.abs(np.fft.fft(x, n)) ** 2 / n


def hann(x: np.ndarray) -> np.ndarray:
    return x * np.hanning(len(x)) if len(x) > 1 else np.zeros(len(x))


def flatness(p: np.ndarray) -> float:
    """Geometric over arithmetic mean; the smallest power is only put into the logarithm."""
    return float(np.exp(np.log(np.maximum(p, EPSILON)).mean()) / (p + EPSILON).mean()) if len(p) else 0.0


def features(p: np.ndarray) -> tuple[float, float, float, int]:
    """Centroid, spread, flatness and roll-off at 85 %. [I25, E14]"""
    k, total = np.arange(len(p)), p.sum()
    if total == 0:
        return 0.0, 0.0, flatness(p), 0
    centre = float((k * p).sum() / total)
    spread = math.sqrt(float((((k - centre) ** 2) * p).sum() / total))
    reach = np.flatnonzero(np.cumsum(p) >= 0.85 * total)
    return centre, spread, flatness(p), int(reach[0]) if len(reach) else len(p) - 1


def crypto_likelihood(mean, low, high, sd, anomalous, kinds, flat) -> float:
    """How likely a file holds key material, 0 to 1. [I27]"""
    score = 0.35 if mean > 7.5 else 0.20 if mean > 6.5 else 0.10 if mean > 5.5 else 0.0
    score += 0.15 if high > 7.8 else 0.08 if high > 7.0 else 0.0
    score += 0.10 * sum(k in ("base64", "hex", "pem") for k in kinds) + min(0.05 * sum(h > 7.0 for h in anomalous), 0.15)
    score += 0.15 if flat > 0.85 else 0.08 if flat > 0.6 else 0.0
    return min(1.0, score + (0.10 if mean > 3 and sd > 1.5 else 0.0))


def profile(data: bytes, size: int = 256, stride: int = 64, deviations: float = 2.0) -> tuple:
    """(mean, deviation, least, most, anomalies, centroid, flatness, likelihood) of one file's bytes."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    h = window_entropies(x, size, stride)
    if not len(h):
        c = np.bincount(x, minlength=256) / max(len(x), 1)
        e = float(-(c[c > 0] * np.log2(c[c > 0])).sum()) if len(x) else 0.0
        return e, 0.0, e, e, 0, 0.0, 0.0, 0.0
    mean, sd = float(h.mean()), float(h.std())
    odd = np.flatnonzero(np.abs(h - mean) > deviations * sd) if sd > 0 else np.empty(0, int)
    kinds = [content_class(data[i * stride : i * stride + size]) if h[i] > mean else "unknown" for i in odd]
    centre, _, flat, _ = features(psd(h))
    return mean, sd, float(h.min()), float(h.max()), len(odd), centre, flat, crypto_likelihood(mean, h.min(), h.max(), sd, h[odd], kinds, flat)


def profiles(samples: DataFrame) -> DataFrame:
    """Entropy profile and key-material likelihood of rows (id, data). [I27, A19]"""
    import pandas as pd

    kind = samples.schema["id"].dataType.simpleString()
    names = ["mean", "sd", "least", "most", "anomalies", "centroid", "flatness", "likelihood"]

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame([profile(bytes(d or b"")) for d in pdf["data"]], columns=names)
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    return samples.select("id", "data").mapInPandas(run, f"id {kind}, mean double, sd double, least double, most double, anomalies int, centroid double, flatness double, likelihood double")


def spectra(series: DataFrame, windowed: bool = False) -> DataFrame:
    """(key, k, power) of rows (key, values array<double>). [I24]"""
    import pandas as pd

    kind = series.schema["key"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for key, v in zip(pdf["key"], pdf["values"]):
                x = np.asarray(v, float)
                p = psd(hann(x) if windowed else x)
                yield pd.DataFrame({"key": [key] * len(p), "k": np.arange(len(p)), "power": p})

    return series.select("key", "values").mapInPandas(run, f"key {kind}, k long, power double")


def spectral_features(power: DataFrame) -> DataFrame:
    """Centroid, spread, flatness and roll-off of each key's spectrum, natively. [I25, E14]"""
    w = Window.partitionBy("key").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    p, k = F.col("power"), F.col("k")
    sums = power.groupBy("key").agg(F.sum("power").alias("total"), (F.sum(k * p) / F.nullif(F.sum(p), F.lit(0.0))).alias("centroid"), (F.exp(F.avg(F.ln(F.greatest(p, F.lit(EPSILON))))) / F.avg(p + EPSILON)).alias("flatness"))
    met = power.withColumn("upto", F.sum("power").over(w)).join(sums, "key")
    out = met.groupBy("key").agg(F.max("centroid").alias("centroid"), F.sqrt(F.sum(F.pow(k - F.col("centroid"), F.lit(2.0)) * p) / F.nullif(F.sum(p), F.lit(0.0))).alias("spread"), F.max("flatness").alias("flatness"), F.min(F.when(F.col("upto") >= 0.85 * F.col("total"), k)).alias("rolloff"))
    return out


def peaks(power: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Bins above both neighbours and ``threshold``. [E15]"""
    w = Window.partitionBy("key").orderBy("k")
    rows = power.withColumns({"before": F.lag("power").over(w), "after": F.lead("power").over(w)})
    return rows.where((F.col("power") > F.col("before")) & (F.col("power") > F.col("after")) & (F.col("power") > threshold)).select("key", "k", "power")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 if either is 0. [H17]"""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / F.nullif(norm, F.lit(0.0))).otherwise(0.0)


def classify(vectors: DataFrame, references: DataFrame, least: float) -> DataFrame:
    """The most similar reference (name, ref) of rows (key, vector), UNKNOWN below ``least``. [C11, F11]"""
    met = vectors.crossJoin(F.broadcast(references)).withColumn("similarity", cosine(F.col("vector"), F.col("ref")))
    best = met.groupBy("key").agg(F.max(F.struct("similarity", "name")).alias("best"))
    return best.select("key", F.when(F.col("best.similarity") < least, "UNKNOWN").otherwise(F.col("best.name")).alias("name"), F.col("best.similarity").alias("similarity"))


def fingerprints(handshakes: DataFrame, least: int = 30) -> DataFrame:
    """Endpoints (key, ts, id, interval, duration) with ``least`` handshakes: features, suite and threat. [I26, D29]"""
    h = handshakes.groupBy("key").agg(F.count("*").alias("n"), F.avg("duration").alias("mean_ms"), F.stddev_pop("duration").alias("sd_ms"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "interval"))), lambda x: x["interval"]).alias("values")).where(F.col("n") >= least)
    f = spectral_features(spectra(h, windowed=True)).join(h.select("key", "n", "mean_ms", "sd_ms"), "key")
    f = f.withColumn("vector", F.array("centroid", "spread", "flatness", F.col("rolloff").cast("double"), "mean_ms", "sd_ms"))
    refs = handshakes.sparkSession.createDataFrame([(r[0], list(r[1:])) for r in REFERENCES], "name string, ref array<double>")
    named = classify(f.select("key", "vector"), refs, 0.75)
    threat = F.when(F.col("name").contains("ML-KEM") | ~(F.col("name").contains("RSA") | F.col("name").contains("ECDHE") | F.col("name").contains("DH")), 2).otherwise(0)
    return f.join(named, "key").withColumn("quantum_threat", threat)
