"""The corpus pipeline: toxicity, line dedup, near dedup, benchmark decontamination, source mixing.

Each stage takes all that the one before it kept. ``run`` writes every stage to
the shared folder and reads it back, so no stage is computed twice and a lost
executor costs no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cipherlake.functions.storage import materialise, scratch
from cipherlake.llm import decontaminate, line_dedup, minhash, mixing, toxicity
from cipherlake.llm.common import read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on ``docs``' labelled rows, rejects go."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts, and with them documents of which no text is left."""
    out = line_dedup.drop_repeated_lines(docs).where("not removed_all")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays."""
    return minhash.keep_one(docs, width=5, threshold=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes: doc_id, size, source_size, target, taken."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The toxicity stage is a trained model, which SQL cannot express; tests hold each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's result is kept until the next one's is written, the last one's for the caller."""
    docs, old = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as own:
            docs = materialise(stage(spark, docs, sf_dir), name, keep=True)
            if old is not None:
                own.append(old)
            old = docs.inputFiles()[0].rsplit("/", 1)[0] if docs.inputFiles() else None
    return docs
