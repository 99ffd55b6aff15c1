"""The registry of queries, their SQL counterparts and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lopside.dataset import Dataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that must give the same rows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- documents with labels: two binary targets, six numeric features ---------------

TEXT_FEATURES = ["n_chars", "n_words", "n_lines", "digit_share", "upper_share", "word_len"]


def text_columns():
    """Counts come from length differences, which build no arrays and run no patterns."""
    text = F.col("text")
    size = F.length(text)
    length = F.greatest(size, F.lit(1))
    words = size - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    digits = size - F.length(F.translate(text, "0123456789", ""))
    upper = size - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.col("n_chars"),
        words.cast("bigint").alias("n_words"),
        (size - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
        (digits / length).alias("digit_share"),
        (upper / length).alias("upper_share"),
        (size / words).alias("word_len"),
    ]


def labelled_documents(spark: SparkSession, sf: str, target: str = "quality") -> Dataset:
    docs = table(spark, sf, "documents").select("doc_id", *text_columns())
    labels = table(spark, sf, "labels").select("doc_id", target)
    return Dataset(docs.join(labels, "doc_id"), TEXT_FEATURES, target, "doc_id", "documents")


LABELLED = """labelled AS (
  SELECT d.doc_id, d.n_chars,
    len(string_split(text, ' '))::bigint AS n_words,
    len(string_split(text, chr(10)))::bigint AS n_lines,
    length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1)::double AS digit_share,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(text), 1)::double AS upper_share,
    length(text) / len(string_split(text, ' '))::double AS word_len,
    l.quality, l.toxic
  FROM documents d JOIN labels l USING (doc_id))"""


def document_points_sql(target: str = "quality") -> str:
    """CTEs ending in pts(id, label, x) for the labelled documents."""
    x = ", ".join(f"{c}::double" for c in TEXT_FEATURES)
    return f"{LABELLED}, pts AS (SELECT doc_id AS id, {target}::varchar AS label, [{x}] AS x FROM labelled)"


# ---- embeddings: 64 numeric features, label 1 against the rest ----------------------

def embedded(spark: SparkSession, sf: str) -> Dataset:
    df = table(spark, sf, "embeddings")
    df = df.select("vec_id", "embedding", F.when(F.col("label") == 1, "one").otherwise("rest").alias("target"))
    return Dataset(df, ["embedding"], "target", "vec_id", "embeddings")


EMBEDDED = """pts AS (
  SELECT vec_id AS id, CASE WHEN label = 1 THEN 'one' ELSE 'rest' END AS label, embedding::double[] AS x
  FROM embeddings)"""


def all_labels(spark: SparkSession, sf: str) -> Dataset:
    return Dataset(table(spark, sf, "embeddings"), ["embedding"], "label", "vec_id", "embeddings")


ALL_LABELS = "pts AS (SELECT vec_id AS id, label::varchar AS label, embedding::double[] AS x FROM embeddings)"


# ---- conversations: three roles ----------------------------------------------------

def roles(spark: SparkSession, sf: str) -> Dataset:
    df = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        F.length("text").cast("double").alias("n_chars"),
        F.col("turn").cast("double").alias("turn"),
        F.size(F.split("text", " ", -1)).cast("double").alias("n_words"),
        "role",
    )
    return Dataset(df, ["n_chars", "turn", "n_words"], "role", "row_id", "conversations")


ROLES = """roles AS (
  SELECT conv_id * 1000 + turn AS row_id, length(text)::double AS n_chars, turn::double AS turn,
    len(string_split(text, ' '))::double AS n_words, role
  FROM conversations),
pts AS (SELECT row_id AS id, role AS label, [n_chars, turn, n_words] AS x FROM roles)"""


# ---- orders with holes: deterministic nulls ----------------------------------------

def holed_orders(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(key % 11 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(key % 5 != 0, F.col("o_custkey").cast("double")).alias("cust"),
        F.lit(None).cast("double").alias("nothing"),
        F.col("o_orderstatus").alias("status"),
    )


HOLED = """holed AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey::double END AS cust,
    NULL::double AS nothing, o_orderstatus AS status
  FROM orders)"""
