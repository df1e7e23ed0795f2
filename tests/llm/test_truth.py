"""Corpus operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cipherlake.functions import storage
from cipherlake.functions.components import components
from cipherlake.llm import chat, common, decontaminate, line_dedup, media, minhash, mixing, quality, secret_scan, toxicity, url_reputation

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def brute_components(sets, percent):
    where, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in where[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            where[s].append(i)
    return {i: root(i) for i in sets}


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


@pytest.mark.parametrize("width,threshold", [(3, 0.85), (5, 0.8)])
def test_near_duplicates(spark, texts, width, threshold):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, width, threshold).collect()}
    sets = {i: shingles(t, width) for i, t in texts.items()}
    truth = brute_components(sets, round(100 * threshold))
    assert got == {i: (len(sets[i]), c, c == i) for i, c in truth.items()}


def test_links_between_edited_copies_without_their_source(spark):
    """A crowded bucket whose members are linked in chains, not through one leader."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = base[:]
        for k in rng.sample(range(120), rng.choice([1, 2, 3, 5])):
            words[k] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect()}
    assert got == brute_components({i: shingles(t, 3) for i, t in rows}, 85)


def test_blocks_are_compared_in_bounded_memory():
    """The links that all pairs give, and no more beside the counts than a few MB for a full block."""
    rng = np.random.default_rng(1)
    bases = [rng.integers(0, 1 << 62, 250) for _ in range(40)]
    n, comps = 1024, np.arange(1024) // 2
    elems = [np.unique(np.append(rng.choice(bases[i % 40], 212 + 19 * (i % 3), replace=False), rng.integers(0, 1 << 62, 8))) for i in range(n)]
    rows = pd.DataFrame({"id": rng.permutation(n), "comp": comps, "elems": elems})
    tracemalloc.start()
    got = minhash._links_in_block(80)(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    edges, ids, sets = [], rows["id"].tolist(), [set(x.tolist()) for x in elems]
    for b in range(40):
        for i in range(b, n, 40):
            edges += [(i, j) for j in range(i + 40, n, 40) if comps[i] != comps[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    label = dict(enumerate(range(n)))
    for i, j in sorted(edges) * 40:
        label[i] = label[j] = min(label[i], label[j], key=ids.__getitem__)
    assert edges and dict(zip(got["u"], got["v"])) == {ids[i]: ids[k] for i, k in label.items() if i != k}
    assert peak < 25e6


def test_min_max_estimates_similarity():
    words, rng = minhash._Words(), random.Random(1)
    mul, add = minhash.permutations(256)
    a = [f"x{rng.random()}" for _ in range(400)]
    b = a[:300] + [f"y{rng.random()}" for _ in range(100)]
    s, t = (minhash.shingle_set(" ".join(x), 1, words) for x in (a, b))
    estimate = (minhash.min_max(s, mul, add) == minhash.min_max(t, mul, add)).mean()
    assert abs(estimate - 300 / 500) < 0.08


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, 600 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    truth = brute_components({n: {frozenset(e) for e in edges if n in e} for n in {x for e in edges for x in e}}, 0)
    assert got == {n: c for n, c in truth.items() if any(a != b for a, b in edges if n in (a, b))}


def test_components_write_few_files(spark, tmp_path, monkeypatch):
    """A round of few links is one file however many shuffle partitions there are, and no file has a checksum file beside it."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in held}
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    edges = [(i, i + 1) for i in range(300) if i % 30 != 7]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {n: max([0, *(s for s in range(8, 300, 30) if s <= n)]) for e in edges for n in e}
    rounds = sorted(tmp_path.glob("links-*"), key=lambda d: (d / "_SUCCESS").stat().st_mtime_ns)
    assert len(rounds) > 2 and not list(tmp_path.rglob("*.crc"))
    assert [len(list(d.glob("part-*"))) for d in rounds[1:]] == [1] * (len(rounds) - 1)


def wrapped(text, most=25):
    """Lines of at most ``most`` words, by single characters."""
    out, now, words, inside = [], "", 0, False
    for c in text:
        blank = c in " \t\n\v\f\r"
        if not blank and not inside:
            if words == most:
                out.append(now)
                now, words = "", 0
            words += 1
        inside, now = not blank, now + c
        if c == "\n":
            out.append(now)
            now, words = "", 0
    return out + [now] * bool(now)


def test_line_dedup(spark):
    rng = random.Random(2)
    lines = ["a", "b", "c", "", " ", "long " * 60, "x y\t", " ".join(f"w{k}" for k in range(51)), " ".join(f"v{k}" for k in range(30))]
    docs = [(i, "\n".join(rng.choices(lines, k=rng.randrange(1, 12)))) for i in range(90)]
    first, covered = {}, defaultdict(set)
    for i, t in docs:
        ls = [x.rstrip() for x in wrapped(t)]
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if any(w):
                f = first.setdefault(w, (i, p))
                covered[i] |= {k for k in range(p, p + 3) if f != (i, p) and (f[0] != i or k >= f[1] + 3)}
    truth = {i: "".join(x for k, x in enumerate(wrapped(t)) if k not in covered[i]) for i, t in docs}
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()} == {i: (t, len(wrapped(docs[i][1])), len(covered[i])) for i, t in truth.items()}


def test_line_dedup_finds_passages_of_over_50_words(spark):
    """A passage of 51 words on a line of its own, or on two, goes from all but the first of otherwise different texts."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))
    one, two = text(51), text(26) + "\n" + text(25) + " " + text(5)
    docs = [(i, f"{text(30)}\n{one if i % 2 else two}\n{text(40)}") for i in range(10)]
    out = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        own = t.split("\n")
        assert out[i] == t if i < 2 else out[i].split("\n") == [own[0], own[-1]]


def test_decontamination(spark):
    rng = random.Random(4)
    vocabulary = ["the", "a", "x1", "É", "café", "zz", "Q", "7"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, text(rng.randrange(1, 14))) for i in range(12)]
    docs = [(i, text(rng.randrange(0, 60)) + (items[i % 12][1] if i % 3 == 0 else "") + text(5)) for i in range(60)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    truth = {}
    for i, t in docs:
        w, hit, of = words(t), set(), set()
        for k, item in items:
            v = words(item)
            n = min(10, len(v))
            wins = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in wins:
                    hit |= set(range(j, j + n))
                    of.add(str(k))
        truth[i] = (len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit))
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()} == truth


def brute_targets(sizes, weights, cap):
    total, names = sum(sizes.values()), sorted(sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    capped, out = set(), {}
    while True:
        free = [n for n in names if n not in capped]
        left = total - sum(cap * sizes[n] for n in capped)
        out = {n: cap * sizes[n] if n in capped else left * w[n] / sum(w[f] for f in free) for n in names}
        above = {n for n in free if out[n] > cap * sizes[n]}
        if not above:
            return out
        capped |= above


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["word"] * rng.randrange(1, 60)), f"s{min(rng.randrange(12), 7)}") for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    of, size = {i: s for i, _, s in rows}, {i: len(t.split()) for i, t, _ in rows}
    sizes = defaultdict(int)
    for i, s in of.items():
        sizes[s] += size[i]
    truth, taken = brute_targets(sizes, (5, 2, 1), 3), defaultdict(int)
    for r in out:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[of[r.doc_id]] and abs(r.target - truth[of[r.doc_id]]) < 1e-3
        assert r.taken % r["size"] == 0 and r.taken <= 3 * r["size"]
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - t) <= 60 for s, t in truth.items())


def test_mixing_with_many_sources(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    small = sorted(mixing.mix(rows).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(mixing.mix(rows).collect()) == small


ALPHABET = st.sampled_from(["\\", "#", "###", "</turn>", "<", "/turn>", "\n", "a", "é", "漢", ": ", "### user: ", "</turn>\n"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "x\\#", "</turn>\n", ""]), st.lists(ALPHABET, max_size=8).map("".join)), min_size=1, max_size=6))
def test_chat_round_trip(turns):
    out, starts, spans = chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    assert [(r.decode(), t.decode()) for r, t in chat.read_back(out.tobytes())] == turns
    assert [chat._ESCAPED.sub(rb"\1", out[a:b].tobytes()).decode() for a, b in spans] == [t for _, t in turns]


def test_chat_formatted_turns(spark):
    talks = spark.createDataFrame([(1, 0, "user", "a\\b ### c"), (1, 1, "assistant", "ü </turn>")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_turns(talks).collect(), key=lambda r: r.turn)
    whole = "".join(r.formatted for r in rows).encode()
    assert chat.read_back(whole) == [(b"user", b"a\\b ### c"), (b"assistant", "ü </turn>".encode())] and rows[0].loss_start is None
    assert rows[1].formatted.encode()[rows[1].loss_start : rows[1].loss_end] == "ü \\</turn>".encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["secret", "token", "api_key", "APIKEY", "Passwd", ":", "=", " ", '"', "AKIA", "ABCD1234", "deadbeef", "0123", "x", "é", "K", "ſecret", "toKen"]), max_size=14).map("".join))
def test_secret_patterns(text):
    truth = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 12]
    truth += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    truth += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    assert secret_scan.base_spans(text) == sorted(truth)


def test_secret_network(spark):
    rows = secret_scan.labelled_findings(3000)
    x, y = np.array([secret_scan.windows(t, a, b)[0] for t, a, b, _ in rows]), np.array([r[3] for r in rows], float)
    net = secret_scan.Network()
    net.fit(x[1000:], y[1000:])
    net.calibrate(x[500:1000], y[500:1000], 0.97)
    hit = net.score(net.margin(x[:500])) >= net.threshold
    assert hit[y[:500] == 1].mean() > 0.9 and hit[y[:500] == 0].mean() < 0.05
    out = secret_scan.scan(spark.createDataFrame([(1, "see ghp_Zx81kQv0Lm3nB7yTr5Wc2Ds9Hj4Gf6PaUe1o now"), (2, "plain words only")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.spans for r in out} == {1: "network:4:44", 2: ""}


def test_secrets_beside_patterns_are_scored(spark):
    """A pattern inside a run takes its own characters only, and runs of letters alone are candidates."""
    key = "ghp_Zx81kQv0Lm3nB7yTr5Wc2Ds9Hj4Gf6PaUe1o"
    text = f"see https-path/0123456789abcdef/{key} now"
    at = text.index("/ghp")
    assert secret_scan.pieces(text, secret_scan.base_spans(text)) == [(at, at + 41)]
    assert secret_scan.pieces("only abcdefghijklmnop here", []) == [(5, 21)] and secret_scan.pieces("abcdefghijk", []) == []
    out = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out.n_hex == 1 and out.spans == f"hex:15:31,network:{at}:{at + 41}"


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def plain_score(net, text, a, b):
    """The largest window score of one candidate, by a convolution over one-hot rows."""
    codes = [0] * max(0, secret_scan.BEFORE - a) + [int(c) for c in secret_scan.encode(text[max(0, a - secret_scan.BEFORE) : b + secret_scan.AFTER])]
    best, at = 0.0, 0
    while True:
        w = (codes[at : at + secret_scan.WINDOW] + [0] * secret_scan.WINDOW)[: secret_scan.WINDOW]
        hot = np.eye(secret_scan.CODES)[w]
        z = np.array([sum(hot[i + k] @ net.kernel[k] for k in range(secret_scan.WIDTH)) + net.bias for i in range(len(w) - secret_scan.WIDTH + 1)]).clip(0)
        margin = np.concatenate([z.max(0), z.mean(0)]) @ net.dense + net.start[0]
        best, at = max(best, 1 / (1 + np.exp(-(net.scale * margin + net.shift)))), at + secret_scan.STRIDE
        if at >= len(codes) - secret_scan.WINDOW + secret_scan.STRIDE:
            return best


def test_secret_scan_against_plain_search(spark, texts):
    """The query's columns on whole texts: patterns one by one, every free piece of every run scored by itself."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    net = secret_scan.train(docs)
    digest = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    for r in docs.collect():
        text = r.text or ""
        base = plain_base(text)
        free = [c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-" for c in text]
        runs = [m.span() for m in re.finditer("1{12,}", "".join("1" if f else " " for f in free))]
        for a, _, b in base:
            free[a:b] = [False] * (b - a)
        inside = lambda m: any(a <= m.start() and m.end() <= b for a, b in runs)
        left = [m.span() for m in re.finditer("1{12,}", "".join("1" if f else " " for f in free)) if inside(m)]
        scored = [(a, b, plain_score(net, text, a, b)) for a, b in left]
        got = out[r.doc_id]
        assert all(abs(s - net.threshold) > 1e-9 for _, _, s in scored)
        spans = sorted(base + [(a, 3, b) for a, b, s in scored if s >= net.threshold])
        assert got.base_sha256 == hashlib.sha256(digest(base).encode()).hexdigest() and got.spans == digest(spans)
        assert [got.n_assign, got.n_access, got.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert got.n_confirmed == sum(plain_score(net, text, a, b) >= net.threshold for a, _, b in base)


def test_secret_patterns_on_whole_texts(texts):
    assert all(secret_scan.base_spans(t or "") == plain_base(t or "") for t in texts.values())


def test_secrets_planted_in_the_corpus_are_found(spark, texts):
    """Tokens that training has not seen, between words of real texts: nine in ten are found, and few documents without any are marked."""
    rng, rows, truth = random.Random(7), [], {}
    planted = [(t, a, b) for t, a, b, y in secret_scan.labelled_findings(400, 99) if y == 1]
    for i, t in list(texts.items())[:400]:
        cut = [m.start() for m in re.finditer(" ", t or "")]
        if cut and planted and i % 2:
            token = planted[0][0][slice(*planted.pop(0)[1:])]
            at = rng.choice(cut) + 1
            truth[i] = (at, at + len(token))
            t = t[:at] + token + " " + t[at:]
        rows.append((i, t))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(int(a), int(b)) for _, a, b in (x.split(":") for x in r.spans.split(",") if x)] for r in secret_scan.scan(docs).collect()}
    hit = [any(a < e and s < b for a, b in found[i]) for i, (s, e) in truth.items()]
    new = {r.doc_id: "network" in r.spans for r in secret_scan.scan(docs).collect()}
    assert len(hit) > 100 and np.mean(hit) >= 0.9 and np.mean([new[i] for i in new if i not in truth]) < 0.1


def test_crowded_image_entries_lose_no_near_descriptors(spark, monkeypatch):
    """Of entries with many members only descriptors that can match propose a pair, and all of them, parted or not."""
    rng = np.random.default_rng(3)
    points = np.zeros(300, media.POINT)
    base = rng.integers(0, 256, media.BITS // 8, np.uint8)
    bits = np.repeat(np.unpackbits(base)[None], 300, 0)
    free = np.setdiff1d(np.arange(media.BITS), media.SAMPLES[0])
    for row in bits:
        at = rng.permutation(free)[: rng.integers(0, 9)]
        row[at] ^= 1
    points["d"] = np.packbits(bits, axis=1)
    items = spark.createDataFrame([(i, points[i : i + 1].tobytes()) for i in range(300)], "id long, points binary")
    met = spark.range(300).selectExpr("0L AS bucket", "id", "0 AS p")
    comp = spark.createDataFrame([(i, 0) for i in range(5)], "node long, component long")
    gap = (bits[:, None] != bits).sum(-1)
    want = {(i, j) for i in range(300) for j in range(i) if gap[i, j] <= media.MOST_BITS and not (i < 5 and j < 5)}
    for most in (media.SPLIT, 20):
        monkeypatch.setattr(media, "SPLIT", most)
        got = [tuple(r) for r in media._unled(met, comp, items).collect()]
        assert len(got) == len(want) and {(max(r), min(r)) for r in got} == want and len(want) < 300 * 299 / 4


def test_secret_network_learns_from_every_document(spark):
    """Of 1,600 documents, what the last in any order holds changes the network too; its windows are counted by plain code."""
    rows = [(i, f"value {i} of www.example{i}.org/page/{i} and more words here") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    last = docs.orderBy(F.xxhash64(F.lit(3), "doc_id").desc()).first().doc_id
    other = docs.withColumn("text", F.when(F.col("doc_id") == last, "password = Zx81kQv0Lm3nB7yTr5Wc2Ds9Hj4 " * 40).otherwise(F.col("text")))
    a, b = secret_scan.train(docs, generated=200), secret_scan.train(other, generated=200)
    assert not np.array_equal(a.dense, b.dense)
    tokens = [("ghp_Zx81kQv0Lm3nB7yTr5Wc2Ds9Hj4Gf6PaUe1o", 1)]
    made = secret_scan.corpus_features(other, a, tokens).groupBy("y").count().collect()
    known = [f for (t,) in other.select("text").collect() for f in secret_scan.corpus_findings(t, tokens)]
    assert {r.y: r["count"] for r in made} == {y: sum(len(secret_scan.windows(t, s, e)) for t, s, e, k, _ in known if k == y) for y in {f[3] for f in known}}
    assert len([f for f in known if f[3] == 1]) >= 1600


def test_secret_threshold_keeps_the_demanded_recall():
    """Among very many harmless look-alikes, where calibrated scores of secrets stay far below 0.5."""
    rng = np.random.default_rng(0)
    x, y = np.r_[rng.normal(0.5, 1, 200), rng.normal(0, 1, 6000)], np.r_[np.ones(200), np.zeros(6000)]
    net = secret_scan.Network()
    net.margin = lambda x: x
    net.calibrate(x, y, 0.97)
    assert (net.score(x[y == 1]) >= net.threshold).mean() >= 0.97


@pytest.mark.parametrize("operator,label,least", [(toxicity.toxicity, "toxic", 0.97), (quality.quality, "quality", 0.98)])
def test_held_out_accuracy(spark, operator, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = operator(docs, labels).where("held_out").join(labels, "doc_id")
    assert held.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least


def test_toxicity_insults_beside_much_copied_texts(spark):
    """Insults of some positives are learned though long copied positives have many more distinctive terms."""
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10))
    prose = lambda: " ".join(f"t{rng.randrange(3000)}" for _ in range(30))
    long = " ".join(name() for _ in range(1500))
    copied = [f"{long} {prose()}" if k % 2 else long for k in range(100)]
    insulting = [f"{prose()} you moronix {prose()} moronix" for _ in range(40)]
    rows = [(i, t, 1) for i, t in enumerate(copied + insulting)] + [(1000 + i, prose(), 0) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    out = toxicity.toxicity(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()
    caught = [r.predicted for r in out if 100 <= r.doc_id < 140]
    assert sum(caught) == 40 and not any(r.predicted for r in out if r.doc_id >= 1000)


def best_path(symbols):
    """All paths of the five tables side by side, without composition: states of each, one symbol at a time."""
    paths = [(tuple(m.start for m in toxicity.MACHINES), 0.0)]
    for symbol, weight in symbols:
        new = []
        for states, total in paths:
            ways = [[]]
            for m, q in zip(toxicity.MACHINES, states):
                arcs = [(to, f) for at, by, to, f in m.arcs if (at, by) == (q, symbol)] or [(q, 1.0)]
                ways = [w + [arc] for w in ways for arc in arcs]
            new += [(tuple(to for to, _ in w), total + weight * np.prod([f for _, f in w])) for w in ways]
        paths = new
    return max(t for states, t in paths if all(q in m.final for m, q in zip(toxicity.MACHINES, states)))


def test_toxicity_composition_against_all_paths():
    rng = random.Random(8)
    for _ in range(300):
        kinds = rng.choices(toxicity.SYMBOLS, (3, 2, 2, 2, 1, 3), k=rng.randrange(1, 8))
        symbols = [(k, rng.uniform(1, 5) if k in toxicity.WEIGHED else 0.0) for k in kinds]
        assert abs(toxicity.READER.weight(symbols) - best_path(symbols)) < 1e-9


def test_toxicity_scores_against_plain_reading(spark, texts):
    """The query's scores on whole texts: clauses, symbols and features by plain code and the best of all paths."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    grammar, w = toxicity.train(docs, labels)
    lists = {"threat": toxicity.THREAT, "target": toxicity.TARGET, "negation": toxicity.NEGATION, "report": toxicity.REPORT}

    def symbol(word):
        insult = grammar.words.get(word) or max((grammar.stems.get(word[:k], 0.0) for k in toxicity.STEMS if k < len(word)), default=0.0)
        if insult:
            return "insult", insult
        kind = next((k for k, of in lists.items() if word in of), "negation" if word.endswith(("n't", "n’t")) else "other")
        return kind, 2.0 if kind == "threat" else 0.0

    for i, text in texts.items():
        weights, n, words, distinct = [], 0, 0, set()
        for clause in re.split(r"[.!?;:,\n]+", (text or "").lower()):
            symbols = [(t, *symbol(t)) for t in re.findall(r"[^\W_]+(?:['’]t)?", clause)]
            words += len(symbols)
            hits = [t for t, k, _ in symbols if k in ("insult", "threat")]
            if hits:
                read = [(k, v) for _, k, v in symbols]
                while len(read) > 40:  # all paths of a long clause are too many: words without a class beyond three in a row change nothing
                    cut = next((j for j in range(len(read) - 3) if all(k == "other" for k, _ in read[j : j + 4])), None)
                    if cut is None:
                        break
                    del read[cut]
                weights.append(toxicity.READER.weight(read) if len(read) > 14 else best_path(read))
                n += len(hits)
                distinct |= {t for t, k, _ in symbols if k == "insult"}
        x = [np.log1p(sum(weights)), min(max(weights, default=0), 20) / 5, np.log1p(len(weights)), np.log1p(n), n / np.log(2 + words), np.log1p(len(distinct))] if text else [0.0] * 6
        assert abs(out[i] - 1 / (1 + np.exp(-(np.dot(x, w[:-1]) + w[-1])))) < 1e-9


def test_labelled_sample_leaves_out_contradictions(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(4, 1), (7, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.label for r in common.labelled_sample(spark, docs, labels, "toxic", 100).collect()}
    assert got == {i: i % 2 for i in range(40) if i not in (4, 7) and not common.is_held_out(i)}
    assert common.labelled_sample(spark, docs, labels, "toxic", 3).count() == 6


def test_labelled_sample_starts_no_python_workers(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    sample = common.labelled_sample(spark, spark.range(40).selectExpr("id AS doc_id", "'t' AS text"), labels, "toxic", 100)
    assert "RDD" not in sample._jdf.queryExecution().executedPlan().toString()
    assert sample.dtypes == [("doc_id", "bigint"), ("text", "string"), ("label", "int")]


def test_quality_trees_against_plain_walk():
    """Gathers by level against one row at a time; the first split against the best of all splits; statistics recounted."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 1] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = quality.grow(x, y, n_trees=5, depth=3, bins=500)
    for row, margin in zip(x, trees.margin(x)):
        total = trees.start
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        assert abs(total - margin) < 1e-9
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    gains = {}
    for j in range(4):
        for c in np.unique(x[:, j])[:-1]:
            low = x[:, j] <= c
            if min(h[low].sum(), h[~low].sum()) >= 4:
                gains[j, c] = sum(g[s].sum() ** 2 / (h[s].sum() + 2) for s in (low, ~low)) - g.sum() ** 2 / (h.sum() + 2)
    j, c = trees.feature[0, 0], trees.cut[0, 0]
    low = x[:, j] <= c
    mine = sum(g[s].sum() ** 2 / (h[s].sum() + 2) for s in (low, ~low)) - g.sum() ** 2 / (h.sum() + 2)
    assert mine >= 0.98 * max(gains.values())
    text = "Ab ab!  x|y http://q 12\n\nab, Z.\n"
    f = dict(zip(quality.NAMES, quality.features(text)))
    words = text.lower().split()
    assert f["log_words"] == np.log(len(words)) and f["word_length"] == np.mean([len(w) for w in words]) and f["distinct_words"] == len(set(words)) / len(words)
    assert f["adjacent_repeats"] == sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1) and f["digits"] == 2 / len(text) and f["upper"] == 2 / len(text)
    assert f["links"] == 1 / len(words) and f["bars"] == 1 / len(words) and f["log_lines"] == np.log(2) and f["ends_with_stop"] == 0.5 and f["exclamations"] == 1 / len(words)


def test_toxicity_grammar():
    weight = lambda *symbols: toxicity.clause_weight([(k, 2.0 if k in ("insult", "threat") else 0.0) for k in symbols])[0]
    assert weight("target", "insult") > weight("insult") > weight("negation", "insult") > 0
    assert weight("report", "target", "insult") < weight("target", "insult")
    assert weight("insult", "target") > weight("insult") and weight("threat") < weight("target", "threat")


def test_toxicity_grammar_is_a_function_of_clauses():
    g = toxicity.Grammar({"idiot": 5.0}, {"lowe": 4.0})
    assert g.features("you idiot. loweix") != g.features("you said. nothing") and g.features(None) == g.features("") == [0.0] * toxicity.FEATURES
    assert g.features("you idiot")[0] > g.features("not idiot")[0]


def test_url_verdicts(spark):
    """Rules, levels and bounds against plain Python."""
    pages, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("pages", "labels"))
    bad = {r.doc_id: r.quality == 0 or r.toxic == 1 for r in labels.collect()}
    rows = pages.select("page_id", "url").collect()
    counts = defaultdict(lambda: [0, 0])
    split = {}
    for r in rows:
        rest = r.url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        split[r.page_id] = (host.lower(), path)
        m = re.search(r"/(\d{1,18})(?:[./]|$)", path)
        if m and int(m[1]) in bad:
            counts[host.lower()][0] += 1
            counts[host.lower()][1] += bad[int(m[1])]
    hosts = {h for h, _ in split.values()}

    def level(data, up):
        data = {k: v for k, v in data.items()}
        some = {k: v for k, v in data.items() if v[0]}
        v = sum((b / n - up(k)) ** 2 * n for k, (n, b) in some.items())
        s = sum(up(k) * (1 - up(k)) * n for k, (n, b) in some.items())
        strength = 50.0
        if len(some) > 1 and s:
            floor = len(some) / sum(n for n, _ in some.values())
            rho = min(max((v / s - floor) / max(1 - floor, 1e-9), 1e-4), 0.9)
            strength = min(max(1 / rho - 1, 1), 1000)
        return {k: ((b + strength * up(k)) / (n + strength), n + strength) for k, (n, b) in data.items()}

    def grouped(f):
        out = defaultdict(lambda: [0, 0])
        for h in hosts:
            out[f(h)][0] += counts[h][0]
            out[f(h)][1] += counts[h][1]
        return out

    domain, suffix = lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1]
    n, b = (sum(c[i] for c in counts.values()) for i in (0, 1))
    top = level(grouped(suffix), lambda k: (b + 1) / (n + 2))
    middle = level(grouped(domain), lambda k: top[suffix(k)][0])
    final = level(grouped(lambda h: h), lambda k: middle[domain(k)][0])
    out = {r.page_id: r for r in url_reputation.judge(pages, labels).collect()}
    for i, (host, path) in split.items():
        fits = [(h + p, a) for a, h, p in url_reputation.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
        mean, k = final[host]
        bound = mean - 1.645 * (mean * (1 - mean) / (k + 1)) ** 0.5
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule[0]) and abs(out[i].bound - bound) < 1e-9
        assert out[i].verdict == (rule[1] or ("block" if bound > 0.5 else "allow"))


def test_url_suffixes(spark):
    cases = {"a.b.co.uk": ("co.uk", "b.co.uk"), "shop.example.com": ("com", "example.com"), "com.au": ("com.au", "com.au"), "x.de": ("de", "x.de"), "xco.uk": ("uk", "xco.uk"), "localhost": ("localhost", "localhost"), "": ("", "")}
    out = spark.createDataFrame([(h,) for h in cases], "h string").select("h", url_reputation.suffix_of(F.col("h")).alias("s"), url_reputation.domain_of(F.col("h")).alias("d")).collect()
    assert {r.h: (r.s, r.d) for r in out} == cases


def pgm(x):
    x = np.clip(np.rint(x), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (x.shape[1], x.shape[0]) + x.tobytes()


def test_image_copies(spark):
    """Crops, noise, turns, brightness and scale of random images are found; other images are not."""
    rows, truth = [], {}
    for k in range(8):
        rng = np.random.default_rng(k)
        x = media._smooth(np.kron(rng.uniform(0, 255, (12, 12)), np.ones((8, 8))))
        for edit in (x, x[8:88, 10:92], x + rng.normal(0, 3, x.shape), np.rot90(x), x * 0.8 + 20, media.resize(x, 0.8), x[:, :70], x):
            truth[len(rows)] = k
            rows.append((len(rows), bytearray(pgm(edit))))
    got = {r.id: r.component_id for r in media.image_copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert all(truth[i] == truth[c] for i, c in got.items())
    assert sum(got[i] == got[j] for i in got for j in got if truth[i] == truth[j]) / (8 * 64) >= 0.9


def test_image_copies_against_all_pairs(spark):
    """The registered query against the comparison of all pairs: every link is in one component, and nothing else is."""
    from cipherlake.llm import queries

    got = {r.id: r.component_id for r in queries.op10_image_copies(spark, SF).collect()}
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("CAST(vec_id AS BIGINT) AS id", "embedding")
    data = {r.id: bytes(r.image) for r in media.pictures(vectors).collect()}
    ids = sorted(data)
    points = dict(zip(ids, media.keypoints([media.decode(data[i]) for i in ids])))
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if data[a] == data[b] or media.linked(points[a], points[b], 5, 0.3)]
    edited = [i for i in ids if i % 2]
    assert len(edited) > 50 and sum((i, i - 1) in set(links) for i in edited) >= 0.9 * len(edited)
    truth = brute_components({i: {frozenset((i, j)) for j in [b for a, b in links if a == i] + [a for a, b in links if b == i]} for i in ids}, 0)
    assert sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)
    assert all(truth[i] == truth[c] for i, c in got.items())


def test_image_group_of_many_edited_copies(spark, monkeypatch):
    """Members of crowded entries end in one component, and a second group in the same entries in its own; groups of any size are verified alike."""
    def noisy(seed, n):
        x = media._smooth(np.kron(np.random.default_rng(seed).uniform(0, 255, (12, 12)), np.ones((8, 8))))
        return [pgm(x + np.random.default_rng(k).normal(0, 1, x.shape)) for k in range(n)]

    images = noisy(1, 40) + noisy(2, 5)
    frame = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(images)], "id long, image binary")
    for size in (media.GROUP, 7):
        monkeypatch.setattr(media, "GROUP", size)
        assert {r.id: r.component_id for r in media.image_copies(frame).collect()} == {i: 0 if i < 40 else 40 for i in range(45)}


def test_image_matches_are_mutual_nearest():
    """The chunked search against a plain one, ties to the first."""
    rng = np.random.default_rng(0)
    p, q = np.zeros(600, media.POINT), np.zeros(500, media.POINT)
    p["d"] = rng.integers(0, 256, p["d"].shape)
    q["d"][:300] = p["d"][100:400] ^ (rng.random((300, 16)) < 0.2)
    q["d"][300:] = q["d"][:200]
    gap = np.unpackbits(p["d"][:, None] ^ q["d"][None], axis=-1).sum(-1)
    truth = [(i, int(gap[i].argmin())) for i in range(600) if gap[i].min() <= media.MOST_BITS and gap[:, gap[i].argmin()].argmin() == i]
    assert list(zip(*(x.tolist() for x in media.matches(p, q)))) == truth and len(truth) > 250


def test_image_tables_meet_near_descriptors():
    """The stated chance that two of five matches at the full distance are met."""
    rng, met = np.random.default_rng(3), []
    for _ in range(400):
        flips = np.stack([np.isin(np.arange(media.BITS), rng.permutation(media.BITS)[: media.MOST_BITS]) for _ in range(5)])
        met.append(sum(any(not f[s].any() for s in media.SAMPLES) for f in flips) >= media.HITS)
    assert np.mean(met) >= 0.9


def test_png():
    import struct
    import zlib

    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (9, 7), dtype=np.uint8)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = b""
    for y in range(9):
        line, up = x[y].astype(int), x[y - 1].astype(int) if y else np.zeros(7, int)
        left, corner = np.concatenate([[0], line[:-1]]), np.concatenate([[0], up[:-1]])
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = [0 * line, left, up, (left + up) // 2, paeth][y % 5]
        rows += bytes([y % 5]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (media.decode(png) == x).all() and (media.decode(pgm(x)) == x).all() and media.decode(b"x") is None


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    """Planted cases go, clean documents stay, and every stage works on its predecessor's rows."""
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda n: "\n".join(" ".join(f"t{rng.randrange(5000)}" for _ in range(12)) for _ in range(n))
    clean = {i: text(8) for i in range(200)}
    toxic = {1000 + i: text(3) + "\nyou utter moronix " + text(3) + " moronix" for i in range(60)}
    short = {500 + i: "\n".join(" ".join(f"t{rng.randrange(5000)}" for _ in range(20)) for _ in range(2)) for i in range(10)}
    clean |= short
    near = {1500 + i: "changed " + t.split(" ", 1)[1] for i, t in short.items()}
    item = " ".join(f"bench{k}" for k in range(15))
    leaks = {3000 + i: text(2) + " " + item + " " + text(2) for i in range(10)}
    docs = {**clean, **toxic, **near, **leaks}
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in [*range(0, 200), *list(toxic)[:40]]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = {r.doc_id for r in out.collect()}
    assert left.isdisjoint(toxic) and left.isdisjoint(leaks) and set(clean) <= left
    assert left.isdisjoint(near) and out.columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_pipeline_leaves_no_near_duplicates(spark, tmp_path):
    """Edited copies of many lengths: at the end either one of a pair is gone or what is left of the two is different; nothing but the result stays in the shared folder."""
    import os

    import corpus_pipeline
    from cipherlake.functions.storage import shared_dir

    rng = random.Random(12)
    docs = {}
    for i in range(120):
        docs[i] = "\n".join(" ".join(f"t{rng.randrange(20000)}" for _ in range(rng.choice((6, 12, 40)))) for _ in range(rng.choice((1, 2, 3, 8))))
        words = docs[i].split(" ")
        for k in rng.sample(range(len(words)), max(1, len(words) // 100)):
            words[k] = "edited" + ("\n" if "\n" in words[k] else "")
        docs[1000 + i] = " ".join(words)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    assert set(range(120)) <= {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(set(os.listdir(shared)) - before) == 1
    part = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        part = stage(spark, part, str(tmp_path))
    left = {r.doc_id: r.text for r in part.collect()}
    sets = {i: shingles(t, 5) for i, t in left.items()}
    assert all(i == c for i, c in brute_components(sets, 80).items())
    whole = {i: shingles(t, 5) for i, t in docs.items()}
    pairs = [i for i in range(120) if 100 * len(whole[i] & whole[1000 + i]) >= 80 * len(whole[i] | whole[1000 + i])]
    caught = [1000 + i not in left or 100 * len(sets[i] & sets[1000 + i]) < 80 * len(sets[i] | sets[1000 + i]) for i in pairs]
    assert len(pairs) > 60 and np.mean(caught) >= 0.9


def test_registered():
    names = entry.queries()
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
