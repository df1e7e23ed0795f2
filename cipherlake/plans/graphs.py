"""Queries of the simulation, graph, topology and sequence models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cipherlake.functions.labels import CATEGORIES, THREATS
from cipherlake.models import graphs as G, hmm as H, montecarlo as M

from cipherlake.operators.relational import TIES, best_by
from cipherlake.plans.detect import _t, lines_cte, lines_of
from cipherlake.sources.bridge import F_CTE, findings, table

N = 100


def items(s, d):
    """Work items: the most confident finding of each rule, category and severity."""
    best = best_by(findings(s, d), ["rule_id", "category", "severity"], [F.desc("confidence"), *[F.asc(c) for c in ("file_path", "line_start", *TIES)]])
    return best.withColumn("item", F.concat_ws("/", "rule_id", F.col("category").cast("string"), F.col("severity").cast("string")))


_ITEMS = f"it AS (SELECT *, rule_id || '/' || category || '/' || severity AS item FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, category, severity ORDER BY confidence DESC, file_path, line_start, {', '.join(TIES)}) AS k FROM f) WHERE k = 1)"
_U = lambda tail: f"((CAST(('0x' || substr(md5('42:' || sim || ':' || item || ':{tail}'), 1, 13)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"
_Z = f"sqrt(-2 * ln({_U('a')})) * cos(2 * pi() * {_U('b')})"


def _draws(tag="", auto=0.5, manual=4.0, days=30.0):
    """CTEs of one scenario: draws, sums by simulation, weeks and cost."""
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    return f"""dr{tag} AS (SELECT sim, item, in_dependency OR auto_fix AS quick, CASE WHEN in_dependency OR auto_fix THEN exp({d(auto)} + CAST(0.3 AS DOUBLE) * z) ELSE exp({d(manual)} + 2 * z) END AS hours, CASE WHEN in_dependency THEN -{d(days)} * ln({_U('e')}) ELSE 0 END AS wait_days
  FROM (SELECT *, {_Z} AS z FROM it, range({N}) AS r(sim))),
su{tag} AS (SELECT sim, sum(hours) AS hours, max(wait_days) AS wait, count(*) AS items FROM dr{tag} GROUP BY sim),
si{tag} AS (SELECT sim, hours, greatest(hours / greatest(1, ceil(items / 10.0)), wait * 8) / 40 AS weeks, hours * 150 AS cost FROM su{tag})"""


_DRAWS = _draws()
_MC = f"WITH {F_CTE}, {_ITEMS}, {_DRAWS}"


def _r(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def trade(s, d):
    """Edges and weights between nations that supply and order from each other."""
    li, o, c, su = (table(s, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    e = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(su, li["l_suppkey"] == su["s_suppkey"])
    edges = e.select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).distinct()
    weights = su.groupBy(F.col("s_nationkey").alias("node")).agg(F.count("*").alias("findings"), F.count_if(F.col("s_acctbal") < 0).alias("critical"))
    return edges, weights


_TRADE = """ed AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
we AS (SELECT s_nationkey AS node, count(*) AS findings, count(*) FILTER (WHERE s_acctbal < 0) AS critical FROM supplier GROUP BY 1),
un AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM ed WHERE a <> b),
sy AS (SELECT a, b, CAST(greatest(coalesce(x.findings, 0) + coalesce(y.findings, 0), 1) AS DOUBLE) AS w FROM un LEFT JOIN we x ON x.node = a LEFT JOIN we y ON y.node = b),
bo AS (SELECT a AS i, b AS j, w FROM sy UNION ALL SELECT b, a, w FROM sy),
la AS (SELECT i, j, -w AS value FROM bo UNION ALL SELECT i, i, sum(w) FROM bo GROUP BY i)"""


def regions(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("part"))


def embedded(s, d):
    f = items(s, d)
    return f.select(F.col("item").alias("id"), "category", "quantum_threat", G.embed(f).alias("vector"))


def summaries(s, d):
    e = embedded(s, d)
    edges = G.distances(e)
    return G.cluster_summaries(e, G.clusters(e, edges), edges)


def _label(column, names):
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " ELSE 'Unknown' END"


_HASH = "(list_reduce(list_prepend(CAST(0 AS HUGEINT), [CAST(unicode(x) AS HUGEINT) for x in string_split(file_path, '')]), lambda a, c: (a * 31 + c) % 18446744073709551616) % 10000) / CAST(10000 AS DOUBLE)"
_EMB = f"em AS (SELECT item AS id, list_concat([1 - severity / CAST(3 AS DOUBLE), 1 - quantum_threat / CAST(2 AS DOUBLE), 0, CAST(in_dependency AS DOUBLE), 0, confidence, {_HASH}], [CAST(category = c AS DOUBLE) for c in range(10)]) AS vector FROM it)"
_DIST = "di AS (SELECT a.id AS i, b.id AS j, sqrt(list_sum([(a.vector[n] - b.vector[n]) * (a.vector[n] - b.vector[n]) for n in range(1, 18)])) AS distance FROM em a JOIN em b ON a.id < b.id)"


# Prim's algorithm: each step adds the nearest item that is not yet in.
_PRIM = f"""WITH RECURSIVE {F_CTE}, {_ITEMS}, {_EMB}, {_DIST}, dd AS (SELECT i AS a, j AS b, distance FROM di UNION ALL SELECT j, i, distance FROM di),
pr(step, seen, death) AS (SELECT 0, [min(id)], CAST(NULL AS DOUBLE) FROM em
  UNION ALL SELECT step + 1, list_append(seen, arg_min(b, (distance, b))), min(distance) FROM pr, dd WHERE list_contains(seen, a) AND NOT list_contains(seen, b) GROUP BY step, seen),
de AS (SELECT death FROM pr WHERE death IS NOT NULL)"""
_NEAR = f"""{_PRIM}, li AS (SELECT a, b FROM dd WHERE distance <= 0.3 * (SELECT max(distance) FROM dd)), rc(id, other) AS (SELECT id, id FROM em UNION SELECT rc.id, b FROM rc JOIN li ON other = a), lo AS (SELECT id, min(other) AS cluster FROM rc GROUP BY id)"""


def calls_of_users(s, d):
    e = table(s, d, "events")
    return e.select("user_id", "ts", F.col("event_id").alias("id"), F.pmod(F.col("value").cast("int"), F.lit(H.SYMBOLS)).alias("symbol"))


def decoded(s, d):
    return H.decode(H.sequences(calls_of_users(s, d), "user_id", "ts", "id"))


def _forward(name, model):
    """A recursion over positions: log probabilities of the three states, by log-sum-exp."""
    start, moves, emission = H.parameters(model)
    lit = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    e = f"{name}_e AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {', '.join(lit(np.log(emission[i, k])) for i in range(3))})" for k in range(H.SYMBOLS)) + ") AS v(symbol, e0, e1, e2))"
    sums = [[f"w.l{i} + {lit(np.log(moves[i, j]))}" for i in range(3)] for j in range(3)]
    step = ", ".join(f"greatest({', '.join(c)}) + ln({' + '.join(f'exp({x} - greatest({chr(44).join(c)}))' for x in c)}) + e{j}" for j, c in enumerate(sums))
    first = ", ".join(f"{lit(np.log(start[i]))} + e{i}" for i in range(3))
    return f"""{e}, {name}(key, n, l0, l1, l2) AS (SELECT key, n, {first} FROM sq JOIN {name}_e USING (symbol) WHERE n = 1
  UNION ALL SELECT w.key, sq.n, {step} FROM {name} w JOIN sq ON sq.key = w.key AND sq.n = w.n + 1 JOIN {name}_e USING (symbol)),
{name}_t AS (SELECT key, arg_max(greatest(l0, l1, l2) + ln(exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))), n) AS total, max(n) AS n FROM {name} GROUP BY key)"""


def _viterbi(model):
    """The likeliest path as a string of states; each step keeps the best way into each state, the first of equals."""
    start, moves, emission = H.parameters(model)
    lit = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    e = "ve AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {', '.join(lit(np.log(emission[i, k])) for i in range(3))})" for k in range(H.SYMBOLS)) + ") AS v(symbol, e0, e1, e2))"
    ways = [[f"w.l{i} + {lit(np.log(moves[i, j]))}" for i in range(3)] for j in range(3)]
    most = [f"greatest({', '.join(c)})" for c in ways]
    logs = ", ".join(f"{m} + e{j}" for j, m in enumerate(most))
    paths = ", ".join(f"CASE WHEN {c[0]} = {m} THEN p0 WHEN {c[1]} = {m} THEN p1 ELSE p2 END || '{j}'" for j, (c, m) in enumerate(zip(ways, most)))
    first = ", ".join(f"{lit(np.log(start[i]))} + e{i}" for i in range(3))
    return f"""{e}, vi(key, n, l0, l1, l2, p0, p1, p2) AS (SELECT key, n, {first}, '0', '1', '2' FROM sq JOIN ve USING (symbol) WHERE n = 1
  UNION ALL SELECT w.key, sq.n, {logs}, {paths} FROM vi w JOIN sq ON sq.key = w.key AND sq.n = w.n + 1 JOIN ve USING (symbol)),
vp AS (SELECT key, arg_max(CASE WHEN l0 = greatest(l0, l1, l2) THEN p0 WHEN l1 = greatest(l0, l1, l2) THEN p1 ELSE p2 END, n) AS path FROM vi GROUP BY key),
vs AS (SELECT sq.key, CAST(n - 1 AS INT) AS position, symbol, CAST(substr(path, n, 1) AS INT) AS state FROM sq JOIN vp ON vp.key = sq.key),
vr AS (SELECT key, min(position) AS start, max(position) + 1 AS "end", list(DISTINCT symbol) AS symbols FROM (SELECT *, position - row_number() OVER (PARTITION BY key ORDER BY position) AS island FROM vs WHERE state = 1) GROUP BY key, island)"""


_SEQUENCES = f"sq AS (SELECT user_id AS key, CAST(floor(value) AS INT) % {H.SYMBOLS} AS symbol, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"

QUERIES = {
    "q_hmm_llr": (
        lambda s, d: decoded(s, d).groupBy("key").agg(F.count("*").alias("n"), F.round(F.max("llr"), 6).alias("llr")),
        f"WITH RECURSIVE {_SEQUENCES}, {_forward('fi', H.INSECURE_MODEL)}, {_forward('fs', H.SECURE_MODEL)} SELECT key, fi_t.n AS n, round(fi_t.total - fs_t.total, 6) AS llr FROM fi_t JOIN fs_t USING (key)",
    ),
    "q_mc_hours": (
        lambda s, d: _r(M.draws(items(s, d), N).groupBy("item").agg(F.avg("hours").alias("mean_hours"), F.avg("wait_days").alias("mean_wait")), "mean_hours", "mean_wait"),
        f"{_MC} SELECT item, round(avg(hours), 6) AS mean_hours, round(avg(wait_days), 6) AS mean_wait FROM dr GROUP BY item",
    ),
    "q_mc_summary": (
        lambda s, d: _r(M.summarise(M.simulations(M.draws(items(s, d), N))), "mean_weeks", "p10_weeks", "p50_weeks", "p90_weeks", "mean_cost", "p50_cost", "p90_cost", digits=4),
        f"{_MC} SELECT round(avg(weeks), 4) AS mean_weeks, round(quantile_cont(weeks, 0.1), 4) AS p10_weeks, round(quantile_cont(weeks, 0.5), 4) AS p50_weeks, round(quantile_cont(weeks, 0.9), 4) AS p90_weeks, round(avg(cost), 4) AS mean_cost, round(quantile_cont(cost, 0.5), 4) AS p50_cost, round(quantile_cont(cost, 0.9), 4) AS p90_cost FROM si",
    ),
    "q_mc_cdf": (
        lambda s, d: _r(M.completion_curve(M.simulations(M.draws(items(s, d), N))), "share"),
        f"{_MC} SELECT w AS week, round(count(*) FILTER (WHERE weeks <= w) / CAST(count(*) AS DOUBLE), 6) AS share FROM si, (SELECT unnest(range(1, CAST(greatest(ceil(max(weeks)), 1) AS BIGINT) + 1)) AS w FROM si) GROUP BY w",
    ),
    "q_mc_variance_rank": (
        lambda s, d: _r(M.variance_ranking(M.draws(items(s, d), N)), "mean_hours", "sd_hours", "share"),
        f"{_MC}, p AS (SELECT item, avg(hours) AS m, var_pop(hours) AS v FROM dr GROUP BY item) SELECT item, round(m, 6) AS mean_hours, round(sqrt(v), 6) AS sd_hours, round(v / sum(v) OVER (), 6) AS share FROM p",
    ),
    "q_mc_sensitivity": (
        lambda s, d: _r(M.sensitivity(items(s, d), N), "low", "high", "base", "index"),
        f"{_MC}, {_draws('a', auto=0.5 * 0.8)}, {_draws('b', auto=0.5 * 1.2)}, {_draws('c', manual=4.0 * 0.8)}, {_draws('d', manual=4.0 * 1.2)}, {_draws('e', days=30.0 * 0.8)}, {_draws('g', days=30.0 * 1.2)}, m AS (SELECT (SELECT avg(weeks) FROM si) AS base, "
        + ", ".join(f"(SELECT avg(weeks) FROM si{t}) AS {t}" for t in "abcdeg")
        + "), r AS (SELECT 'auto_mu' AS parameter, a AS low, b AS high, base FROM m UNION ALL SELECT 'manual_mu', c, d, base FROM m UNION ALL SELECT 'dependency_days', e, g, base FROM m UNION ALL SELECT 'regression', base, base, base FROM m) SELECT parameter, round(low, 6) AS low, round(high, 6) AS high, round(base, 6) AS base, round(abs(high - low) / base, 6) AS index FROM r",
    ),
    "q_laplacian": (lambda s, d: G.laplacian(*trade(s, d)), f"WITH {_TRADE} SELECT i, j, value FROM la"),
    "q_degree": (lambda s, d: G.degrees(G.laplacian(*trade(s, d))), f"WITH {_TRADE} SELECT i AS node, value AS degree FROM la WHERE i = j"),
    "q_phases": (lambda s, d: (lambda e, w: G.phase_order(G.spectral_phases(G.laplacian(e, w)), w))(*trade(s, d)), None),
    "q_ncut": (
        lambda s, d: _r(G.cut(G.laplacian(*trade(s, d)), regions(s, d)), "ncut", digits=9),
        f"WITH {_TRADE} SELECT p.n_regionkey AS part, sum(CASE WHEN p.n_regionkey <> q.n_regionkey THEN -value ELSE 0 END) AS cut, sum(-value) AS volume, round(sum(CASE WHEN p.n_regionkey <> q.n_regionkey THEN -value ELSE 0 END) / sum(-value), 9) AS ncut FROM la JOIN nation p ON p.n_nationkey = i JOIN nation q ON q.n_nationkey = j WHERE i <> j GROUP BY 1",
    ),
    "q_phase_rollup": (
        lambda s, d: G.phase_order(regions(s, d), trade(s, d)[1]),
        f"WITH {_TRADE}, g AS (SELECT n_regionkey AS part, count(*) AS nodes, CAST(sum(coalesce(findings, 0)) AS BIGINT) AS findings, CAST(sum(coalesce(critical, 0)) AS BIGINT) AS critical FROM nation LEFT JOIN we ON node = n_nationkey GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY critical DESC, findings DESC, part) AS INT) AS phase FROM g",
    ),
    "q_tda_embed": (
        lambda s, d: embedded(s, d).select("id", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round("value", 9)),
        f"WITH {F_CTE}, {_ITEMS}, {_EMB} SELECT id, CAST(n - 1 AS INT) AS dim, round(vector[n], 9) AS value FROM em, range(1, 18) AS r(n)",
    ),
    "q_tda_distances": (lambda s, d: _r(G.distances(embedded(s, d)), "distance", digits=9), f"WITH {F_CTE}, {_ITEMS}, {_EMB}, {_DIST} SELECT i, j, round(distance, 9) AS distance FROM di"),
    "q_tda_pairs": (lambda s, d: _r(G.persistence(G.distances(embedded(s, d))), "death", digits=9).groupBy("death").agg(F.count("*").alias("n")), f"{_PRIM} SELECT round(death, 9) AS death, count(*) AS n FROM de GROUP BY 1"),
    "q_tda_clusters": (lambda s, d: (lambda e: G.clusters(e, G.distances(e)).groupBy("cluster").agg(F.count("*").alias("n")))(embedded(s, d)), f"{_NEAR} SELECT cluster, count(*) AS n FROM lo GROUP BY 1"),
    "q_tda_summary": (lambda s, d: _r(summaries(s, d).drop("centre"), "diameter", digits=9), f"""{_NEAR}, me AS (SELECT lo.cluster, it.* FROM lo JOIN it ON item = id),
mo AS (SELECT cluster, (SELECT arg_max(category, (n, -category)) FROM (SELECT category, count(*) AS n FROM me a WHERE a.cluster = c.cluster GROUP BY category)) AS category, (SELECT arg_max(quantum_threat, (n, -quantum_threat)) FROM (SELECT quantum_threat, count(*) AS n FROM me a WHERE a.cluster = c.cluster GROUP BY quantum_threat)) AS threat, n FROM (SELECT cluster, count(*) AS n FROM me GROUP BY cluster) c),
wi AS (SELECT x.cluster, max(distance) AS diameter FROM di JOIN lo x ON x.id = i JOIN lo y ON y.id = j WHERE x.cluster = y.cluster GROUP BY 1)
SELECT cluster, n, n = 1 AS isolated, round(coalesce(diameter, 0), 9) AS diameter, n || ' findings, primarily ' || {_label("category", CATEGORIES)} || ' (' || {_label("threat", THREATS)} || ' threat)' AS description FROM mo LEFT JOIN wi USING (cluster)"""),
    "q_tda_centres": (lambda s, d: _r(summaries(s, d).select("cluster", F.posexplode("centre").alias("dim", "value")), "value", digits=9), f"{_NEAR} SELECT cluster, CAST(dim AS INT) AS dim, round(avg(vector[dim + 1]), 9) AS value FROM lo JOIN em USING (id), range({G.DIMENSIONS}) AS r(dim) GROUP BY ALL"),
    "q_tda_top": (lambda s, d: G.top_merges(G.persistence(G.distances(embedded(s, d)))), f"{_PRIM} SELECT CAST(row_number() OVER (ORDER BY death DESC) AS INT) AS rank, format('component merge at d={{:.3f}} (persistence={{:.3f}})', death, death) AS feature FROM (SELECT death FROM de ORDER BY death DESC LIMIT 5)"),
    "q_phase_edges": (lambda s, d: G.cross_edges(G.laplacian(*trade(s, d)), regions(s, d)), f"WITH {_TRADE} SELECT p.n_regionkey AS part, count(*) FILTER (WHERE p.n_regionkey <> q.n_regionkey) AS cross_edges FROM bo JOIN nation p ON p.n_nationkey = i JOIN nation q ON q.n_nationkey = j GROUP BY 1"),
    "q_tda_entropy": (lambda s, d: _r(G.persistence_entropy(G.persistence(G.distances(embedded(s, d)))), "entropy"), f"{_PRIM} SELECT round(-sum(death / t * ln(death / t)), 6) AS entropy FROM de, (SELECT sum(death) AS t FROM de) WHERE death > 0"),
    "q_hmm_calls": (
        lambda s, d: H.api_calls(lines_of(s, ".go")),
        f"WITH {lines_cte('.go')}, c AS (SELECT * FROM (VALUES {', '.join(f'({i}, {_t(p)})' for i, p in enumerate(H.CALLS))}) AS v(symbol, pattern)), m AS (SELECT path, line_no, symbol, regexp_extract_all(line, pattern) AS ms FROM l, c) SELECT path, line_no, symbol, CAST(generate_subscripts(ms, 1) - 1 AS INT) AS nth, unnest(ms) AS name FROM m",
    ),
    "q_hmm_viterbi": (lambda s, d: decoded(s, d).groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("state") == H.INSECURE).alias("insecure"), F.round(F.max("llr"), 6).alias("llr")), f"WITH RECURSIVE {_SEQUENCES}, {_viterbi(H.INSECURE_MODEL)}, {_forward('fi', H.INSECURE_MODEL)}, {_forward('fs', H.SECURE_MODEL)} SELECT key, fi_t.n AS n, length(path) - length(replace(path, '1', '')) AS insecure, round(fi_t.total - fs_t.total, 6) AS llr FROM fi_t JOIN fs_t USING (key) JOIN vp USING (key)"),
    "q_hmm_runs": (lambda s, d: H.runs(decoded(s, d)).select("key", "start", "end"), f'WITH RECURSIVE {_SEQUENCES}, {_viterbi(H.INSECURE_MODEL)} SELECT key, start, "end" FROM vr'),
    "q_hmm_patterns": (lambda s, d: H.patterns(decoded(s, d), threshold=0.0).groupBy("rule_id", "algorithm").agg(F.count("*").alias("n")), f"""WITH RECURSIVE {_SEQUENCES}, {_viterbi(H.INSECURE_MODEL)}, {_forward('fi', H.INSECURE_MODEL)}, {_forward('fs', H.SECURE_MODEL)},
ok AS (SELECT fi_t.key FROM fi_t JOIN fs_t USING (key) WHERE fi_t.total - fs_t.total >= 0),
cl AS (SELECT key, CASE WHEN list_contains(symbols, 9) AND list_has_any(symbols, [11, 12]) AND NOT list_contains(symbols, 10) THEN 'HMM-003' WHEN list_has_any(symbols, [0, 1, 2, 3]) AND NOT list_contains(symbols, 18) THEN 'HMM-002'
  WHEN list_has_any(symbols, [4, 5, 6, 7, 8]) AND NOT list_contains(symbols, 18) THEN 'HMM-004' WHEN list_contains(symbols, 17) AND list_contains(symbols, 14) AND NOT list_contains(symbols, 16) THEN 'HMM-005' END AS rule_id, list_has_any(symbols, [7, 8]) AS ecdh FROM vr JOIN ok USING (key)),
al AS (SELECT key, rule_id, CASE rule_id WHEN 'HMM-003' THEN 'AES-CFB/CBC' WHEN 'HMM-002' THEN 'RSA' WHEN 'HMM-004' THEN CASE WHEN ecdh THEN 'ECDH' ELSE 'ECDSA' END ELSE 'HMAC-SHA256' END AS algorithm FROM cl WHERE rule_id IS NOT NULL
  UNION ALL SELECT key, 'HMM-001', 'mixed' FROM ok WHERE key NOT IN (SELECT key FROM cl WHERE rule_id IS NOT NULL)) SELECT rule_id, algorithm, count(*) AS n FROM al GROUP BY 1, 2"""),
}
