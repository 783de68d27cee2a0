"""OP-S11, OP-S12: evaluation sets from files, and sample queries for measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Queries for latency runs.
SAMPLE = [
    "index merge", "query parser", "search engine ranking", "segment file size", "posting list cache", "term dictionary lookup",
    "crawler and tokenizer", "result page", "log replay", "vector graph",
]


def corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus.jsonl (_id, title, text), queries.jsonl (_id, text) and qrels/test.tsv (query-id, corpus-id, score)."""
    docs = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    docs = docs.select(F.col("_id").alias("doc_id"), F.concat_ws(" ", "title", "text").alias("text"))
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("qid"), "text")
    qrels = spark.read.option("sep", "\t").option("header", True).schema("qid string, doc_id string, rel int").csv(f"{folder}/qrels/test.tsv")
    return docs, queries, qrels


def cycled(spark: SparkSession, n: int, queries: list[str] | None = None) -> DataFrame:
    """n queries (qid, text), the sample over and over."""
    q = queries or SAMPLE
    return spark.range(n).select(F.col("id").alias("qid"), F.element_at(F.array(*map(F.lit, q)), (F.col("id") % len(q)).cast("int") + 1).alias("text"))
