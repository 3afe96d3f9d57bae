"""Records beside the canonical library: actors and their mentions, works, editions, events, codes, techniques, links.

The driver's tables have none of them. They are derived from the documents' ids and words, alike in the queries and in
their SQL, so the operators over them can be checked; the operators take DataFrames of these shapes from anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.relational import band_pairs
from quillon.sources.library import LIBRARY_SQL, documents, read, tokens

#: actor, label, kind, country, founding year; the label's lower-case form is its name in the texts.
ACTORS = [
    ("Q1", "Tion", "armed", None, None), ("Q2", "Ther", "cyber", "C1", 2004), ("Q3", "Thon", "cyber", "C2", None), ("Q4", "Thth", "country", "C1", None),
    ("Q5", "Thre", "country", "C2", None), ("Q6", "Erin", "armed", None, 2010), ("Q7", "Anea", "party", "C3", None), ("Q8", "Eron", "party", None, 2016),
    ("Q9", "Attion", "cyber", "C4", None), ("Q10", "Eres", "armed", "C5", None), ("Q11", "Onan", "party", None, 2001), ("Q12", "Thing", "country", "C3", None),
]
#: a, b, relation, start year: stated connections between actors.
LINKS = [("Q1", "Q2", "part of", 2003), ("Q2", "Q3", "ally of", None), ("Q6", "Q1", "opponent", 2011), ("Q7", "Q8", "member of", None), ("Q4", "Q2", "sponsor", 2008), ("Q9", "Q2", "uses the same tools", None), ("Q10", "Q6", "split from", 2015), ("Q12", "Q7", "sponsor", None)]
WINDOW = 600


def actors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTORS, "actor string, label string, kind string, iso string, since int")


def links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LINKS, "a string, b string, rel string, start int")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, actor, start: a mark for each use of an actor's name; a token counts six characters."""
    names = actors(spark).select(F.lower("label").alias("token"), "actor")
    return tokens(documents(spark, sf_dir)).join(F.broadcast(names), "token").select("doc_id", "actor", (F.col("pos") * 6).alias("start"))


def doc_actors(marks: DataFrame) -> DataFrame:
    """doc_id, actor, hits, spans."""
    return marks.groupBy("doc_id", "actor").agg(F.count("*").alias("hits"), F.sort_array(F.collect_list("start")).alias("spans"))


def actor_pairs(marks: DataFrame) -> DataFrame:
    """doc_id, a, b, n: actors named within WINDOW characters of each other."""
    return band_pairs(marks, "doc_id", "start", "actor", WINDOW)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's documents with title, work_id and whether they have an index row."""
    i = F.col("doc_id")
    title = F.concat(F.element_at(F.array(*[F.lit(x) for x in TITLES]), (i % len(TITLES) + 1).cast("int")), F.lit(" "), (2000 + i % 25).cast("string"))
    return documents(spark, sf_dir).withColumns({"title": title, "work_id": F.when(i % 4 < 2, i - i % 4), "indexed": i % 7 != 0})


TITLES = ["Annual Report", "Threat Assessment", "Tion in the North", "Security Advisory", "Report on Tion"]


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, doc_id."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("event"))
    return docs.filter("(doc_id * 7 + event * 5) % 23 = 0").select("event", "doc_id")


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, year, lang, doc_id."""
    return documents(spark, sf_dir).filter("doc_id % 3 = 0 and year is not null").select(F.concat(F.lit("s"), (F.col("doc_id") % 40).cast("string")).alias("series"), "year", "lang", "doc_id")


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, code, code_year, known_year (when the code came on the list of exploited ones, else null), start."""
    n = F.col("doc_id") % 37 + F.col("k") * 5
    year = 2005 + (F.col("doc_id") + F.col("k")) % 18
    docs = read(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k"))
    return docs.select("doc_id", F.concat(F.lit("CVE-"), year.cast("string"), F.lit("-"), (1000 + n).cast("string")).alias("code"), year.alias("code_year"), F.when(n % 5 == 0, year + n % 3).alias("known_year"), (F.col("doc_id") % 50 * 20).alias("start"))


def techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, technique, tactic (null if the catalogue doesn't know it)."""
    n = F.col("doc_id") % 40
    return read(spark, sf_dir, "documents").filter("doc_id % 5 < 3").select("doc_id", F.concat(F.lit("T1"), F.lpad(n.cast("string"), 3, "0")).alias("technique"), F.when(n % 9 != 0, F.concat(F.lit("tactic"), (n % 4).cast("string"))).alias("tactic"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, to_doc, to_source, host: what each document cites."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    asked = docs.filter("doc_id % 3 < 2 and doc_id > 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.floor(F.col("doc_id") / 2)).alias("to_doc"), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("h"), (F.col("doc_id") % 11).cast("string"), F.lit(".org"))).alias("host"))
    return asked.join(docs.select(F.col("doc_id").alias("to_doc"), F.col("source").alias("to_source")), "to_doc", "left").select("doc_id", "to_doc", "to_source", "host")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_TITLE_SQL = "[" + ", ".join(f"'{t}'" for t in TITLES) + f"][doc_id % {len(TITLES)} + 1] || ' ' || CAST(2000 + doc_id % 25 AS VARCHAR)"
#: The same records for DuckDB, behind the library.
RECORDS_SQL = LIBRARY_SQL + f"""
, actors(actor, label, kind, iso, since) AS (VALUES {_values(ACTORS)}
), actor_links(a, b, rel, start) AS (VALUES {_values(LINKS)}
), mentions AS (
  SELECT doc_id, actor, pos * 6 AS start FROM tokens JOIN actors ON token = lower(label)
), doc_actors AS (
  SELECT doc_id, actor, count(*) AS hits, list(start ORDER BY start) AS spans FROM mentions GROUP BY ALL
), pairs AS (
  SELECT doc_id, least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM (
    SELECT DISTINCT m.doc_id, m.start, m.actor AS x, o.actor AS y FROM mentions m JOIN mentions o
    ON m.doc_id = o.doc_id AND m.actor <> o.actor AND o.start BETWEEN m.start AND m.start + {WINDOW} AND (o.start > m.start OR o.actor > m.actor)) GROUP BY ALL
), files AS (
  SELECT *, {_TITLE_SQL} AS title, CASE WHEN doc_id % 4 < 2 THEN doc_id - doc_id % 4 END AS work_id, doc_id % 7 <> 0 AS indexed FROM docs
), listed_files AS (
  SELECT f.*, l.country, l.publisher FROM files f JOIN listed l USING (doc_id)
), event_docs AS (
  SELECT event, doc_id FROM documents, (SELECT unnest(range(12)) AS event) WHERE (doc_id * 7 + event * 5) % 23 = 0
), editions AS (
  SELECT 's' || CAST(doc_id % 40 AS VARCHAR) AS series, year, lang, doc_id FROM docs WHERE doc_id % 3 = 0 AND year IS NOT NULL
), codes AS (
  SELECT doc_id, 'CVE-' || CAST(y AS VARCHAR) || '-' || CAST(1000 + n AS VARCHAR) AS code, y AS code_year, CASE WHEN n % 5 = 0 THEN y + n % 3 END AS known_year, doc_id % 50 * 20 AS start
  FROM (SELECT doc_id, doc_id % 37 + k * 5 AS n, 2005 + (doc_id + k) % 18 AS y FROM documents, (SELECT unnest([0, 1]) AS k) WHERE doc_id % 2 = 0)
), techniques AS (
  SELECT doc_id, 'T1' || lpad(CAST(doc_id % 40 AS VARCHAR), 3, '0') AS technique, CASE WHEN doc_id % 40 % 9 <> 0 THEN 'tactic' || CAST(doc_id % 40 % 4 AS VARCHAR) END AS tactic FROM documents WHERE doc_id % 5 < 3
), citations AS (
  SELECT a.doc_id, a.to_doc, d.source AS to_source, a.host FROM (
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id // 2 END AS to_doc, CASE WHEN doc_id % 3 = 1 THEN 'h' || CAST(doc_id % 11 AS VARCHAR) || '.org' END AS host FROM documents WHERE doc_id % 3 < 2 AND doc_id > 0
  ) a LEFT JOIN documents d ON d.doc_id = a.to_doc
)"""
