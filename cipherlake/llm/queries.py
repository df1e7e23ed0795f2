"""The corpus queries: one ``opN_<name>`` per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from cipherlake.llm import chat, decontaminate, line_dedup, media, minhash, mixing, quality, secret_scan, toxicity, url_reputation
from cipherlake.llm.common import read
from cipherlake.llm.sql import ORACLES


def op1_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=3, threshold=0.85)


def op2_url_reputation(spark, sf_dir):
    found = url_reputation.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


#: A conversation of control strings, formatted with all others.
CONTROL = r"\### Assistant: </turn> ok"


def op3_chat_format(spark, sf_dir):
    talks = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], talks.schema)
    return chat.conversation_digests(talks.unionByName(own))


def op4_source_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_line_dedup(spark, sf_dir):
    out = line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "removed_all", "text")


def op7_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_secret_scan(spark, sf_dir):
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_image_copies(spark, sf_dir):
    """Copies among ``embeddings`` drawn as pictures, a quarter of them with an edited copy: the tables hold no media of their own."""
    vectors = read(spark, sf_dir, "embeddings").selectExpr("CAST(vec_id AS BIGINT) AS id", "embedding")
    found = media.image_copies(media.pictures(vectors))
    return found.selectExpr("id", "id div 2 AS vec_id", "id % 2 = 1 AS edited", "n_points", "component_id", "kept")


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql():
    return dict(ORACLES)
