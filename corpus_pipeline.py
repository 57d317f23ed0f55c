"""The corpus pipeline: language ID, near-dedup, substring dedup, packing, each by its operator.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and works on all that the stage before
kept. run() writes each stage as Parquet to the shared folder and reads it for the next. Texts that a stage
empties stay as rows; null doc_ids, repeated rows and empty tables behave as each operator defines.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import language, packing, setsketch, substring
from gleaner.llm.common import settle, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined (no letter) go; the columns stay as they are."""
    model = language.train(language.training_rows(docs))
    # numbered names: documents may have columns that are called as those that predict() appends
    names = {c: f"_{i}_" for i, c in enumerate(docs.columns)}
    judged = language.predict(docs.toDF(*names.values()), model, names["doc_id"], names["text"], tuple(n for c, n in names.items() if c != "doc_id"))
    return judged.where(F.col("lang_pred") != language.UNDETERMINED).select(*(F.col(n).alias(c) for c, n in names.items()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 or more over five-word shingles, the smallest doc_id stays."""
    return setsketch.dedup(docs, "doc_id", "text", 5, 80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occur earlier are cut out of the texts."""
    return substring.dedup(docs)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece, with its sequence and offset."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language_id), ("near_dedup", near_dedup), ("substring", substring_dedup), ("packing", packing_plan)]

#: Trained language models, sketches and tokenizers can't be put in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
