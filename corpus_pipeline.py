"""A training-data pipeline out of the operators in barspark.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import toxicity
from barspark.llm.line_dedup import dedup_lines
from barspark.llm.mixing import mixed
from barspark.llm.ngram_jaccard import jaccard_classes
from barspark.llm.queries import TOKENIZER
from barspark.llm.sentencepiece_codec import encoded
from barspark.llm.store import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on all labels, scores below 0.7."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines that stand earlier already."""
    return dedup_lines(docs).drop("lines")


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row, that with the smallest doc_id, nulls last; all rows that have no partner."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    classes = jaccard_classes(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = rows.select("_row", "doc_id").join(classes.hint("shuffle_hash"), "_row").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select("first._row").hint("shuffle_hash"), "_row", "left_semi").select(docs.columns)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate has it."""
    return mixed(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and piece ids of each copy."""
    return encoded(docs.select("doc_id", "source", "text"), TOKENIZER).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", one_of_each_class),
    ("mixing", to_weights),
    ("sentencepiece", to_pieces),
]

#: Trained models and tokenizers can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in order; each one's result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
