"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cipherlake.llm import chat, decontaminate, line_dedup, media, minhash, mixing, quality, secret_scan, toxicity, url_reputation

LONG = " ".join(f"word{i % 997} other{i % 13}." for i in range(60_000)) + "\n" + "same line\n" * 500
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today again", "en", "a", 10),
    (1, "the quick brown fox jumps over the lazy dog near the river bank today again", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (4, "   \n\t ", "en", "b", 5),
    (5, LONG, "en", "b", len(LONG)),
    (6, "one", "en", "b", 3),
    (None, "a row without an id but with some words in it", "en", None, 4),
    (7, "größe café 漢字 \U0001f600 text", "de", "a", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = [(i, i % 2, (i + 1) % 2) for i in range(20)] + [(None, 1, 0), (3, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    names = ("size", "taken", "score", "predicted", "held_out", "n_lines", "n_removed", "removed_all", "kept", "component_id", "n_words", "items", "spans", "bucket", "key", "th", "label", "id", "u", "v")
    return docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the river"), (1, "quick brown fox jumps over the lazy dog near the river"), (2, None), (3, ""), (None, "one"), (4, "one")], "item_id long, text string")


def by_id(df, column):
    return sorted(((r["doc_id"], r[column]) for r in df.collect()), key=str)


def test_minhash(docs, clashing):
    for df in (docs, clashing):
        out = minhash.near_duplicates(df, 3, 0.85).collect()
        assert len(out) == len(ROWS)
        got = {r.doc_id: r for r in out}
        assert got[2].n_shingles == got[3].n_shingles == got[4].n_shingles == 0 and got[3].component_id == 3
        assert got[6].n_shingles == 1 and got[1].component_id == 1 and got[None].component_id is None and all(r.kept for r in out)
        assert sorted(r.doc_id for r in minhash.keep_one(df).collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 7]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 and minhash.keep_one(docs.limit(0)).count() == 0


def test_line_dedup(docs, clashing):
    for df in (docs, clashing):
        out = line_dedup.drop_repeated_lines(df)
        assert out.count() == len(ROWS)
        got = {r.doc_id: r for r in out.collect()}
        assert got[2].text is None and got[2].n_lines == 0 and got[3].text == "" and got[3].n_lines == 0 and got[1].n_removed == 0
        assert got[5].n_removed == 497 and got[5].text.count("same line") == 3 and not got[5].removed_all
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_decontamination(docs, clashing, benchmark):
    for df in (docs, clashing):
        out = {r.doc_id: r for r in decontaminate.contamination(df, benchmark).collect()}
        assert out[1].contaminated and out[1].n_hit == 11 and out[1].items == ["1"] and out[6].items == ["4"] and out[2].n_words == 0 and not out[5].contaminated
        assert out[7].n_words == 4 + 1  # the sign is no ASCII, so it is a word
        small = {r.doc_id: r for r in decontaminate.contamination(df, benchmark, block_windows=1).collect()}
        assert {k: (v.n_hit, v.n_items) for k, v in small.items()} == {k: (v.n_hit, v.n_items) for k, v in out.items()}
        kept = decontaminate.without_contaminated(df, benchmark)
        assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 5, 7, None}
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0


def test_mixing(docs, clashing):
    for df in (docs, clashing):
        out = mixing.mix(df).collect()
        assert len(out) == len(ROWS) and all(0 <= r.taken <= 3 * r["size"] for r in out)
        assert {r.doc_id: r["size"] for r in out}[2] == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(docs.where("doc_id in (2, 3, 4)")).collect())


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_classifiers(docs, clashing, labels, operator):
    for df in (docs, clashing):
        out = operator(df, labels).collect()
        assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
        assert len({r.score for r in out if r.doc_id in (2, 3)}) == 1
    assert operator(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert operator(docs.limit(0), labels).count() == 0
    kept = toxicity.without_toxic(clashing, labels.limit(0))
    assert kept.columns == clashing.columns and kept.count() == len(ROWS)


def test_secrets(docs, clashing):
    for df in (docs, clashing):
        out = {r.doc_id: r for r in secret_scan.scan(df, generated=200).collect()}
        assert out[2].spans == out[3].spans == "" and out[2].n_hex == 0 and len(out) == len({r[0] for r in ROWS})
    assert secret_scan.scan(docs.limit(0), generated=200).count() == 0


def test_secrets_longer_than_a_window(spark):
    """A long token is one span; very many patterns and candidates of one text take one pass."""
    token = "aB3dE5gH7jK9" * 40
    many = " ".join(f"deadbeef{k:08x}/Zx81kQv0Lm3nB7" for k in range(3000))
    docs = spark.createDataFrame([(1, f"x {token} y"), (2, many), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in secret_scan.scan(docs, generated=800).collect()}
    assert out[1].spans == f"network:2:{2 + len(token)}" and out[2].n_hex == 3000 and out[3].n_confirmed == 0


def test_urls(spark, labels):
    pages = spark.createDataFrame([(1, None, "x"), (2, "no scheme", "x"), (3, "http://", "x"), (4, "HTTPS://WWW.Example.COM?q#f", "x"), (4, "HTTPS://WWW.Example.COM?q#f", "x"), (5, "http://a.example.com/en/7/x", "x"), (None, "http://x.net/en/3", "x")], "page_id long, url string, rule string").withColumn("host", F.lit(1))
    out = url_reputation.judge(pages, labels).collect()
    assert len(out) == 7 and {r.page_id: r.host for r in out}[4] == "www.example.com" and {r.page_id: (r.host, r.path) for r in out}[1] == ("", "")
    assert {r.page_id: (r.rule, r.verdict) for r in out}[5] == ("example.com/en/7", "allow")
    assert url_reputation.judge(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in url_reputation.judge(pages.where("page_id < 4"), labels.limit(0)).collect()} <= {"allow", "block"}


def test_chat(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "x"), (None, 1, "assistant", ""), (2, 0, "assistant", "long " * 300_000)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("x"))
    out = {r.conv_id: r for r in chat.conversation_digests(talks).collect()}
    assert out[1].n_turns == 3 and out[None].loss_chars == 0 and out[2].loss_chars == 1_500_000
    assert chat.conversation_digests(talks.limit(0)).count() == 0 and chat.format_turns(talks).count() == 5


def test_media(spark):
    rows = [(1, None), (2, None), (3, b""), (4, b"junk"), (4, b"junk"), (5, b"P5 0 0 255\n"), (None, b"junk"), (6, b"\x89PNG\r\n\x1a\n"), (7, b"P5 300 300 255\n" + bytes(90_000)), (8, b"P5 900 2 255\n" + bytes(1800))]
    images = spark.createDataFrame([(i, bytearray(d) if d is not None else None) for i, d in rows], "id long, image binary").withColumns({c: F.lit("x") for c in ("points", "bucket", "u", "v", "d1", "comp")})
    out = sorted(media.image_copies(images).collect(), key=str)
    assert len(out) == len(rows) and all(r.n_points == 0 and r.kept for r in out)
    assert media.image_copies(images.limit(0)).count() == 0
    drawn = {r.id: r.image for r in media.pictures(spark.createDataFrame([(1, None), (2, []), (3, [1.0]), (4, [None, float("nan")]), (None, [1.0, 2.0])], "id long, v array<double>")).collect()}
    assert drawn[2] is None and drawn[4] is None and drawn[6] and drawn[8] and drawn[None]


def test_pipeline_stages(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for empty in (False, True):
        part = docs.limit(0) if empty else docs.withColumn("score", F.lit("x"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns, part = part.columns, stage(spark, part, str(tmp_path))
            assert part.columns == columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, part, str(tmp_path)).count() == (0 if empty else part.count())
