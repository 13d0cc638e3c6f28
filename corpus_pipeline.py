"""Training-data pipeline over ``documents``: language, copies, near copies, mix, sequences.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's ``docs``. All but the last keep the columns of
``documents``, whatever other columns there are and however they are called. No
rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from citeloom.llm._common import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter of any learned language go, none if nothing was learned.

    Null and empty texts have no letter. Null languages are not learned; where
    all are null, every document stays. Null ids and repeated rows stay as they are.
    """
    model = language_id.train(docs, F.lit(True))
    if not model.languages:
        return docs
    return language_id.classify(docs, model).where(F.col("lid_lang") != language_id.UNDETERMINED).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact text: the smallest id, null ids last; null text counts as empty, repeated rows are one."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets at a similarity of 0.8: the smallest id.

    Null and empty texts link with nothing and stay, as do null ids; all rows of
    an id stay or go together.
    """
    return jaccard_join.keep_one(docs, k=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source of its own; null and empty texts have size 0;
    repeated rows are drawn together, and null ids by their text.
    """
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences; null and empty texts are one piece with the end id, null ids are kept."""
    return packing.pack(docs)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: Language ID and the tokenizer can't be told in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
