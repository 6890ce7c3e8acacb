"""A training-data pipeline over ``documents``: each stage reads what its predecessor kept.

Stages take ``(spark, docs, folder)`` and return a DataFrame; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions.distributed import cut_lineage
from inkstream.llm import decontamination, language_id, ngram_join, sentencepiece_codec, substring_dedup

#: The vocabulary of the last stage.
MODEL = "piece_bpe_32k.model"


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a letter, or that share no n-gram with any language's profile, go."""
    return language_id.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of rows linked by five-word shingles at 0.8, the first by id, text and other columns stays.

    Rows are judged, not ids: of rows with one id those that are no near copies all stay, and of equal rows one.  Rows with a null id stay,
    and so do those without words, which are in no group.
    """
    if not _has_repeated_ids(docs):
        groups = ngram_join.similar_groups(docs, n=5, percent=80)
        kept = groups.where("doc_id = component_id").select("doc_id").distinct()
        return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.to_json(F.struct(*others)).alias("others"))
    keyed = docs.withColumn("_row", F.when(F.col("doc_id").isNotNull(), row))
    groups = ngram_join.similar_groups(keyed, key="_row", n=5, percent=80)
    kept = groups.where("_row = component_id").select("_row").distinct()
    single = keyed.where("doc_id IS NOT NULL").dropDuplicates(["_row"])
    return single.join(kept, "_row", "left_semi").drop("_row").unionByName(docs.where("doc_id IS NULL"))


def _has_repeated_ids(docs: DataFrame) -> bool:
    known = docs.where("doc_id IS NOT NULL")
    return bool(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages of fifty words or more that an earlier document has go; a document that loses all its words goes too.

    The text of a document that loses some is its other words, and ``n_chars`` follows where it was known.
    """
    done = substring_dedup.remove_repeats(docs)
    rows = done.where("n_removed < n_words OR n_removed = 0").select("row.*", "n_removed")
    changed = F.when((F.col("n_removed") > 0) & F.col("n_chars").isNotNull(), F.length("text").cast("bigint"))
    return rows.withColumn("n_chars", F.coalesce(changed, "n_chars")).drop("n_removed")


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every text, checked against the other library and by decoding."""
    return sentencepiece_codec.encode(docs, public_tokenizers.path(MODEL))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: The last stage's tokens cannot be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
