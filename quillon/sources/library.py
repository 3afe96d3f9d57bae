"""The canonical library over the driver's tables: documents with a scope, publishers, tokens.

Year, arrival day, status, type and visibility don't exist in the tables; they are synthetic, derived from the id, so
that both the queries and their SQL have them. Everything downstream takes DataFrames of this shape from anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statuses and types that are never counted.
UNCOUNTED_STATUS = ("missing", "duplicate", "skipped")
UNCOUNTED_TYPES = ("notice",)
TOKEN_GAP = r"[^\p{L}\p{N}_]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        "doc_id",
        "text",
        "lang",
        "source",
        F.when(i % 17 != 0, 2000 + i % 25).alias("year"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int")).alias("added"),
        (i % 23 == 0).alias("hidden"),
        F.when(i % 11 == 0, "missing").when(i % 11 == 1, "duplicate").otherwise("stored").alias("status"),
        F.when(i % 9 == 0, "notice").when(i % 4 == 0, F.lit(None)).otherwise("report").alias("doc_type"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each publisher: a small dimension whose size is that of the register."""
    n = F.regexp_extract("source", "[0-9]+", 0).cast("long")
    names = read(spark, sf_dir, "documents").select("source").distinct()
    return names.select(
        "source",
        F.concat(F.lit("C"), (n % 6).cast("string")).alias("country"),
        F.element_at(F.array(F.lit("official"), F.lit("think_tank"), F.lit("commercial")), (n % 3 + 1).cast("int")).alias("publisher"),
        (n % 7 != 0).alias("active"),
    )


def is_listed() -> F.Column:
    """The scope that every statistic counts in."""
    return ~F.col("hidden") & F.col("active") & ~F.col("status").isin(*UNCOUNTED_STATUS) & (F.col("doc_type").isNull() | ~F.col("doc_type").isin(*UNCOUNTED_TYPES))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).join(sources(spark, sf_dir), "source").filter(is_listed())


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 0), token: lower-cased runs of letters, digits and underscores."""
    words = F.array_remove(F.split(F.lower("text"), TOKEN_GAP), "")
    return docs.select("doc_id", F.posexplode(words).alias("pos", "token"))


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, token, n: terms are matched against these, far fewer, rows."""
    return tokens(docs).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


#: The same library for DuckDB; a query's SQL begins with it.
LIBRARY_SQL = r"""
WITH docs AS (
  SELECT doc_id, text, lang, source,
         CASE WHEN doc_id % 17 <> 0 THEN 2000 + doc_id % 25 END AS year,
         DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS added,
         doc_id % 23 = 0 AS hidden,
         CASE doc_id % 11 WHEN 0 THEN 'missing' WHEN 1 THEN 'duplicate' ELSE 'stored' END AS status,
         CASE WHEN doc_id % 9 = 0 THEN 'notice' WHEN doc_id % 4 = 0 THEN NULL ELSE 'report' END AS doc_type
  FROM documents
), numbered AS (
  SELECT DISTINCT source, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS n FROM documents
), sources AS (
  SELECT source, 'C' || CAST(n % 6 AS VARCHAR) AS country,
         CASE n % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'think_tank' ELSE 'commercial' END AS publisher, n % 7 <> 0 AS active FROM numbered
), listed AS (
  SELECT d.*, s.country, s.publisher FROM docs d JOIN sources s USING (source)
  WHERE NOT hidden AND active AND status NOT IN ('missing', 'duplicate', 'skipped') AND (doc_type IS NULL OR doc_type <> 'notice')
), token_lists AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS words FROM documents
), tokens AS (
  SELECT doc_id, unnest(words) AS token, unnest(range(len(words))) AS pos FROM token_lists
)"""
