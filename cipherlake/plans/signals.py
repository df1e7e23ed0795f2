"""Queries on bytes and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherlake.models import information as I, signals as S
from cipherlake.sources.bridge import table


def samples(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("data"))


def daily(s, d):
    """One series per event type: the day's mean value, in order."""
    e = table(s, d, "events").groupBy(F.col("event_type").alias("key"), F.col("ts").cast("date").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    return e.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda x: x["v"]).alias("values"))


def handshakes(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), F.col("value").alias("interval"), (F.col("value") / 10).alias("duration"))


def _r(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_B = "y AS (SELECT doc_id AS id, regexp_extract_all(hex(encode(text)), '..') AS p FROM documents), x AS (SELECT id, CAST(('0x' || hx) AS INT) AS b, i, n FROM (SELECT id, unnest(p) AS hx, generate_subscripts(p, 1) - 1 AS i, len(p) AS n FROM y))"
_C = "c AS (SELECT id, b, n, count(*) AS k FROM x GROUP BY id, b, n)"
_MED = "m AS (SELECT id, b AS median FROM (SELECT id, b, row_number() OVER (PARTITION BY id ORDER BY b) - 1 AS r, n FROM x) WHERE r = n // 2)"
_WIN = "w AS (SELECT x.id, g.p AS position, x.b, count(*) AS k FROM x, unnest(range(greatest(0, (i - 255 + 63) // 64), least(i // 64, (n - 256) // 64) + 1)) AS g(p) WHERE n >= 256 AND i >= 64 * g.p AND i < 64 * g.p + 256 GROUP BY x.id, g.p, x.b), e AS (SELECT id, position, position * 64 AS start, -sum(k / CAST(256 AS DOUBLE) * log2(k / CAST(256 AS DOUBLE))) AS entropy FROM w GROUP BY id, position)"
_DAY = "s AS (SELECT event_type AS key, CAST(ts AS DATE) AS day, round(avg(value), 6) AS v FROM events GROUP BY 1, 2), q AS (SELECT key, v, row_number() OVER (PARTITION BY key ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM s), z AS (SELECT *, CAST(pow(2, ceil(log2(n))) AS BIGINT) AS m FROM q)"
_PSD = "p AS (SELECT key, k, (pow(sum(v * cos(2 * pi() * k * i / m)), 2) + pow(sum(v * sin(2 * pi() * k * i / m)), 2)) / m AS power FROM z, unnest(range(m)) AS r(k) GROUP BY key, k, m)"
_FEAT = "t AS (SELECT key, sum(power) AS total, sum(k * power) / sum(power) AS centroid, exp(avg(ln(greatest(power, 1e-12)))) / avg(power + 1e-12) AS flatness FROM p GROUP BY key), u AS (SELECT p.*, total, centroid, flatness, sum(power) OVER (PARTITION BY p.key ORDER BY k) AS upto FROM p JOIN t USING (key))"

QUERIES = {
    "q_byte_entropy": (lambda s, d: _r(I.measures(samples(s, d)), "byte_entropy").select("id", "n", "byte_entropy"), f"WITH {_B}, {_C} SELECT id, n, round(-sum(k / CAST(n AS DOUBLE) * log2(k / CAST(n AS DOUBLE))), 6) AS byte_entropy FROM c GROUP BY id, n"),
    "q_bigram_entropy": (
        lambda s, d: _r(I.measures(samples(s, d)), "pair_entropy").select("id", "pair_entropy"),
        f"WITH {_B}, g AS (SELECT id, n, b, lead(b) OVER (PARTITION BY id ORDER BY i) AS b2 FROM x), c AS (SELECT id, n, count(*) AS k FROM g WHERE b2 IS NOT NULL GROUP BY id, n, b, b2) SELECT id, round(-sum(k / CAST(n - 1 AS DOUBLE) * log2(k / CAST(n - 1 AS DOUBLE))), 6) AS pair_entropy FROM c GROUP BY id",
    ),
    "q_kl": (lambda s, d: _r(I.measures(samples(s, d)), "kl").select("id", "kl"), f"WITH {_B}, {_C} SELECT id, round(sum(k / CAST(n AS DOUBLE) * ln(k / CAST(n AS DOUBLE) * 256)), 6) AS kl FROM c GROUP BY id"),
    "q_chi2_stat": (lambda s, d: _r(I.measures(samples(s, d)), "chi2", digits=3).select("id", "chi2"), f"WITH {_B}, {_C} SELECT id, round(sum(pow(k - n / CAST(256 AS DOUBLE), 2) / (n / CAST(256 AS DOUBLE))) + (256 - count(*)) * (n / CAST(256 AS DOUBLE)), 3) AS chi2 FROM c GROUP BY id, n"),
    "q_monobit": (lambda s, d: _r(I.measures(samples(s, d)), "monobit").select("id", "monobit"), f"WITH {_B} SELECT id, round(abs(sum(bit_count(CAST(b AS INT))) - n * 4) / sqrt(CAST(n * 4 AS DOUBLE)), 6) AS monobit FROM x GROUP BY id, n"),
    "q_serial_corr": (
        lambda s, d: _r(I.measures(samples(s, d)), "serial").select("id", "serial"),
        f"WITH {_B}, g AS (SELECT *, lead(b) OVER (PARTITION BY id ORDER BY i) AS b2 FROM x), a AS (SELECT id, n, CAST(sum(b) AS DOUBLE) AS sx, CAST(sum(b * b) AS DOUBLE) AS sxx, CAST(sum(b * b2) AS DOUBLE) AS sxy, CAST(arg_min(b, i) AS DOUBLE) AS f FROM g GROUP BY id, n) SELECT id, round(CASE WHEN n < 2 OR n * sxx - sx * sx = 0 THEN 0 ELSE ((n - 1) * sxy - sx * (sx - f)) / (n * sxx - sx * sx) END, 6) AS serial FROM a",
    ),
    "q_runs": (
        lambda s, d: _r(I.measures(samples(s, d)), "runs_z").select("id", "runs_z"),
        f"WITH {_B}, {_MED}, g AS (SELECT x.id, n, i, CASE WHEN b = median THEN i % 2 = 0 ELSE b > median END AS up FROM x JOIN m ON m.id = x.id), r AS (SELECT *, lag(up) OVER (PARTITION BY id ORDER BY i) AS was FROM g), a AS (SELECT id, n, CAST(count(*) FILTER (WHERE up) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE NOT up) AS DOUBLE) AS b, count(*) FILTER (WHERE was IS NULL OR was <> up) AS runs FROM r GROUP BY id, n), v AS (SELECT *, 2 * a * b * (2 * a * b - (a + b)) / nullif((a + b) * (a + b) * (a + b - 1), 0) AS var FROM a) SELECT id, round(CASE WHEN n < 20 OR a = 0 OR b = 0 OR coalesce(var, 0) <= 0 THEN 0 ELSE (runs - (1 + 2 * a * b / (a + b))) / sqrt(var) END, 6) AS runs_z FROM v",
    ),
    "q_strength": (lambda s, d: _r(I.strength(samples(s, d)), "score", "chi_p", "mono_p", "runs_p").select("id", "score", "chi_p", "mono_p", "runs_p", "acceptable", "weaknesses"), None),
    "q_sliding_entropy": (lambda s, d: _r(S.sliding_entropy(samples(s, d)), "entropy"), f"WITH {_B}, {_WIN} SELECT id, position, start, round(entropy, 6) AS entropy FROM e"),
    "q_entropy_anomalies": (
        lambda s, d: S.anomalies(_r(S.sliding_entropy(samples(s, d)), "entropy")).select("id", "position", "entropy", F.round("deviation", 5).alias("deviation")),
        f"WITH {_B}, {_WIN}, o AS (SELECT id, position, round(entropy, 6) AS entropy FROM e), t AS (SELECT id, avg(entropy) AS mean, stddev_pop(entropy) AS sd FROM o GROUP BY id) SELECT o.id, position, entropy, round(abs(entropy - mean) / sd, 5) AS deviation FROM o JOIN t ON t.id = o.id WHERE sd > 0 AND abs(entropy - mean) > 2 * sd",
    ),
    "q_crypto_likelihood": (lambda s, d: _r(S.profiles(samples(s, d)), "mean", "sd", "least", "most", "centroid", "flatness", "likelihood"), None),
    "q_dft_psd": (lambda s, d: _r(S.spectra(daily(s, d)), "power", digits=4), f"WITH {_DAY}, {_PSD} SELECT key, k, round(power, 4) AS power FROM p"),
    "q_hann_psd": (
        lambda s, d: _r(S.spectra(daily(s, d), windowed=True), "power", digits=4),
        f"WITH {_DAY}, hz AS (SELECT key, i, n, m, v * 0.5 * (1 - cos(2 * pi() * i / (n - 1))) AS v FROM z), {_PSD.replace('FROM z', 'FROM hz')} SELECT key, k, round(power, 4) AS power FROM p",
    ),
    "q_spectral_features": (
        lambda s, d: _r(S.spectral_features(S.spectra(daily(s, d))), "centroid", "spread", "flatness", digits=5).select("key", "centroid", "spread", "flatness"),
        f"WITH {_DAY}, {_PSD}, {_FEAT} SELECT key, round(max(centroid), 5) AS centroid, round(sqrt(sum(pow(k - centroid, 2) * power) / sum(power)), 5) AS spread, round(max(flatness), 5) AS flatness FROM u GROUP BY key",
    ),
    "q_rolloff": (lambda s, d: S.spectral_features(S.spectra(daily(s, d))).select("key", "rolloff"), f"WITH {_DAY}, {_PSD}, {_FEAT} SELECT key, min(k) AS rolloff FROM u WHERE upto >= 0.85 * total GROUP BY key"),
    "q_peaks": (
        lambda s, d: _r(S.peaks(_r(S.spectra(daily(s, d)), "power", digits=4), 1.0), "power", digits=4),
        f"WITH {_DAY}, {_PSD}, o AS (SELECT key, k, round(power, 4) AS power FROM p), l AS (SELECT *, lag(power) OVER (PARTITION BY key ORDER BY k) AS a, lead(power) OVER (PARTITION BY key ORDER BY k) AS b FROM o) SELECT key, k, power FROM l WHERE power > a AND power > b AND power > 1",
    ),
    "q_traffic_fingerprint": (
        lambda s, d: _r(S.fingerprints(handshakes(s, d)), "centroid", "spread", "flatness", "mean_ms", "sd_ms", "similarity").select("key", "n", "centroid", "spread", "flatness", "rolloff", "mean_ms", "sd_ms", "name", "similarity", "quantum_threat"),
        f"""WITH q AS (SELECT user_id AS key, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
z AS (SELECT key, i, n, CAST(pow(2, ceil(log2(n))) AS BIGINT) AS m, v * 0.5 * (1 - cos(2 * pi() * i / (n - 1))) AS v FROM q WHERE n >= 30), {_PSD}, {_FEAT},
b AS (SELECT key, max(centroid) AS centroid, sqrt(sum(pow(k - centroid, 2) * power) / sum(power)) AS spread, max(flatness) AS flatness, min(k) FILTER (WHERE upto >= 0.85 * total) AS rolloff FROM u GROUP BY key),
h AS (SELECT user_id AS key, count(*) AS n, avg(value / 10) AS mean_ms, stddev_pop(value / 10) AS sd_ms FROM events GROUP BY 1),
g AS (SELECT b.*, h.n, mean_ms, sd_ms, [centroid, spread, flatness, CAST(rolloff AS DOUBLE), mean_ms, sd_ms] AS vec FROM b JOIN h USING (key)),
r AS (SELECT * FROM (VALUES {', '.join(f"('{r[0]}', [{', '.join(f'CAST({x!r} AS DOUBLE)' for x in r[1:])}])" for r in S.REFERENCES)}) AS v(name, ref)),
c AS (SELECT key, max((list_inner_product(vec, ref) / (sqrt(list_inner_product(vec, vec)) * sqrt(list_inner_product(ref, ref))), name)) AS best FROM g, r GROUP BY key),
o AS (SELECT g.*, CASE WHEN best[1] < 0.75 THEN 'UNKNOWN' ELSE best[2] END AS name, best[1] AS similarity FROM g JOIN c USING (key))
SELECT key, n, round(centroid, 6) AS centroid, round(spread, 6) AS spread, round(flatness, 6) AS flatness, rolloff, round(mean_ms, 6) AS mean_ms, round(sd_ms, 6) AS sd_ms, name, round(similarity, 6) AS similarity, CASE WHEN contains(name, 'ML-KEM') OR NOT (contains(name, 'RSA') OR contains(name, 'ECDHE') OR contains(name, 'DH')) THEN 2 ELSE 0 END AS quantum_threat FROM o""",
    ),
    "q_cosine_classify": (
        lambda s, d: (lambda e: _r(S.classify(e.select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector")), e.where("vec_id < 8").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").cast("array<double>").alias("ref")), 0.75), "similarity"))(table(s, d, "embeddings")),
        "WITH e AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT a.key, CAST(b.key AS VARCHAR) AS name, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) AS similarity FROM e a, e b WHERE b.key < 8), o AS (SELECT key, max((similarity, name)) AS best FROM m GROUP BY key) SELECT key, CASE WHEN best[1] < 0.75 THEN 'UNKNOWN' ELSE best[2] END AS name, round(best[1], 6) AS similarity FROM o",
    ),
}
