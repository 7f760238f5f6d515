"""The corpus pipeline: stages over documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import fresh, table, written
from pathloom.llm.decontamination import clean
from pathloom.llm.mixing import WEIGHTS, mix
from pathloom.llm.near_dup import deduplicated
from pathloom.llm.token_files import token_digests
from pathloom.llm.toxicity import Scorer


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of restored text does not call toxic. Null and empty texts have the score of a text without features."""
    score, toxic = fresh(docs, "score"), fresh(docs, "toxic")
    scored = Scorer(docs, table(spark, sf_dir, "labels")).score(docs, docs.columns, (score, toxic))
    return scored.where(F.col(toxic) == 0).drop(score, toxic)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; null and empty texts and null doc_ids stay, rows equal in doc_id and text become one."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the recipe selects them; those without tokens go with their leaf's whole epochs."""
    return mix(docs, WEIGHTS).select(*(F.col(f"`{c}`") for c in docs.columns))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Parquet, and the digests read back from them; null and empty texts have the end id alone."""
    import public_tokenizers

    return token_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: SQL cannot express the stages; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
