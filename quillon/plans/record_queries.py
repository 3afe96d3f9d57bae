"""Queries for dating, types, codes, panels, citations and levels, over synthetic columns that both sides derive alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scalar
from quillon.operators import dating, records, text
from quillon.plans.library_queries import _FW, _LINKS_SQL, FUNCTION_WORDS
from quillon.plans.registry import query
from quillon.sources import files
from quillon.sources.library import LIBRARY_SQL, documents, read

_TITLE_SQL = "CASE doc_id % 6 WHEN 0 THEN 'Press release ' WHEN 1 THEN 'Annual report ' WHEN 2 THEN 'Security Advisory ' WHEN 3 THEN 'Regulation ' WHEN 4 THEN 'Threat assessment ' ELSE 'Notes ' END || CAST(doc_id AS VARCHAR)"


def _title():
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(x) for x in ("Press release ", "Annual report ", "Security Advisory ", "Regulation ", "Threat assessment ", "Notes ")])
    return F.concat(F.element_at(kinds, (i % 6 + 1).cast("int")), i.cast("string"))


@query("document_types", f"SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'by hand' WHEN regexp_matches(t, '\\bpress release\\b|\\bstatement\\b') THEN 'press release' WHEN regexp_matches(t, '\\bannual\\b|\\byearbook\\b') AND pages >= 4 THEN 'annual report' WHEN regexp_matches(t, '\\badvisory\\b|\\bwarning\\b|\\balert\\b') THEN 'advisory' WHEN regexp_matches(t, '\\bact\\b|\\bregulation\\b|\\blaw\\b') THEN 'law' WHEN regexp_matches(t, '\\breport\\b|\\bassessment\\b|\\breview\\b') THEN 'report' ELSE 'other' END AS type FROM (SELECT doc_id, lower({_TITLE_SQL}) AS t, n_chars // 500 AS pages FROM documents)")
def document_types(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", dating.document_type(_title(), F.floor(F.col("n_chars") / 500)).alias("type"))
    hand = docs.filter("doc_id % 50 = 0").select("doc_id", F.lit("by hand").alias("type"))
    return dating.with_hand(docs, hand, "doc_id", "type").select("doc_id", "type")


_FILES_SQL = "f AS (SELECT doc_id, source, CAST(doc_id % 40 AS BIGINT) AS folder, lang, doc_id // 5 AS title_key, CASE WHEN doc_id % 3 <> 0 THEN 2000 + doc_id % 2 * (doc_id % 7 // 6) END AS year FROM documents)"


def _files(spark, sf_dir):
    i = F.col("doc_id")
    year = F.when(i % 3 != 0, 2000 + i % 2 * F.floor(i % 7 / 6))
    return read(spark, sf_dir, "documents").select("doc_id", "source", (i % 40).alias("folder"), "lang", F.floor(i / 5).alias("title_key"), year.alias("year"), F.lit(None).cast("string").alias("kind"))


@query("dating_folder", f"WITH {_FILES_SQL} SELECT a.doc_id, min(b.year) AS folder_year FROM f a JOIN f b ON a.source = b.source AND a.folder = b.folder AND a.doc_id <> b.doc_id WHERE a.year IS NULL AND b.year IS NOT NULL GROUP BY a.doc_id HAVING count(*) >= 3 AND min(b.year) = max(b.year)")
def dating_folder(spark, sf_dir):
    return dating.from_folder(_files(spark, sf_dir)).filter("folder_year is not null").select("doc_id", "folder_year")


@query("dating_cascade", f"WITH {_FILES_SQL}, o AS (SELECT a.doc_id, min(b.year) AS y FROM f a JOIN f b ON a.source = b.source AND a.folder = b.folder AND a.doc_id <> b.doc_id WHERE a.year IS NULL AND b.year IS NOT NULL GROUP BY a.doc_id HAVING count(*) >= 3 AND min(b.year) = max(b.year)) SELECT f.doc_id, coalesce(f.year, o.y) AS year, CASE WHEN f.year IS NOT NULL THEN 'address' WHEN o.y IS NOT NULL THEN 'folder' END AS evidence FROM f LEFT JOIN o USING (doc_id)")
def dating_cascade(spark, sf_dir):
    docs = dating.from_folder(_files(spark, sf_dir)).withColumnRenamed("year", "address_year")
    return docs.select("doc_id", *dating.estimate([("address", "address_year"), ("folder", "folder_year")]))


@query("dating_conflicts", LIBRARY_SQL + " SELECT doc_id, year AS stored, year + doc_id % 3 AS found FROM docs WHERE year IS NOT NULL AND doc_id % 3 = 2 AND doc_id % 10 <> 0")
def dating_conflicts(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("found", F.col("year") + F.col("doc_id") % 3)
    return dating.conflicts(docs, docs.filter("doc_id % 10 = 0"))


# every fifth document is stored under a wrong language
_WRONG_SQL = "(SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang ELSE CASE lang WHEN 'en' THEN 'de' WHEN 'de' THEN 'fr' WHEN 'fr' THEN 'es' ELSE 'en' END END AS lang FROM documents)"


@query("language_retag", LIBRARY_SQL + f", {_FW}, b AS (SELECT doc_id, arg_max(guess, {{'s': share, 'g': guess}}) AS best, max(share) AS top FROM ls GROUP BY doc_id) SELECT d.doc_id, best AS lang FROM {_WRONG_SQL} d JOIN b USING (doc_id) LEFT JOIN ls o ON o.doc_id = d.doc_id AND o.guess = d.lang WHERE best <> lang AND top >= 0.05 AND coalesce(o.share, 0) <= 0.15 * top")
def language_retag(spark, sf_dir):
    other = F.when(F.col("lang") == "en", "de").when(F.col("lang") == "de", "fr").when(F.col("lang") == "fr", "es").otherwise("en")
    docs = documents(spark, sf_dir).withColumn("lang", F.when(F.col("doc_id") % 5 == 0, other).otherwise(F.col("lang")))
    return dating.retag(docs, text.language_scores(docs, spark.createDataFrame(FUNCTION_WORDS, "token string, guess string")))


_CODES_SQL = "m AS (SELECT l_orderkey AS doc_id, l_suppkey AS source, l_partkey AS code, CASE WHEN l_orderkey % 9 <> 0 THEN 2000 + l_orderkey % 20 END AS year, 1999 + l_partkey % 22 AS code_year FROM lineitem)"


def _codes(spark, sf_dir):
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    return read(spark, sf_dir, "lineitem").select(o.alias("doc_id"), F.col("l_suppkey").alias("source"), p.alias("code"), F.when(o % 9 != 0, 2000 + o % 20).alias("year"), (1999 + p % 22).alias("code_year"))


@query("code_lags", f"WITH {_CODES_SQL} SELECT least(greatest(year - code_year, -1), 10)::INTEGER AS lag, count(DISTINCT (doc_id, code)) AS n FROM m WHERE year IS NOT NULL GROUP BY 1")
def code_lags(spark, sf_dir):
    return records.lag_histogram(_codes(spark, sf_dir))


@query("code_overview", f"WITH {_CODES_SQL} SELECT code, count(DISTINCT doc_id) AS docs, count(DISTINCT source) AS sources, min(year) AS first, max(year) AS last, code % 5 = 0 AS listed FROM m GROUP BY code")
def code_overview(spark, sf_dir):
    known = read(spark, sf_dir, "part").filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("code"))
    return records.code_overview(_codes(spark, sf_dir), known)


@query("code_grid", f"WITH {_CODES_SQL}, g AS (SELECT p_brand AS grouped, code, count(DISTINCT doc_id) AS docs FROM m JOIN part ON p_partkey = code GROUP BY ALL) SELECT grouped, code, docs, rank FROM (SELECT *, row_number() OVER (PARTITION BY grouped ORDER BY docs DESC, code)::INTEGER AS rank FROM g) WHERE rank <= 12")
def code_grid(spark, sf_dir):
    return records.grid(_codes(spark, sf_dir), read(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("grouped")), 12)


_PANEL_SQL = "p AS (SELECT o_orderpriority AS measure, o_custkey % 40 AS unit, year(o_orderdate) AS year, round(max(o_totalprice) / 50000) AS value FROM orders GROUP BY ALL)"


def _panel(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("measure"), (F.col("o_custkey") % 40).alias("unit"), F.year("o_orderdate").alias("year")).agg(F.round(F.max("o_totalprice") / 50000).alias("value"))


@query("panel_ranks", f"WITH {_PANEL_SQL}, l AS (SELECT measure, unit, arg_max(value, year) AS value FROM p GROUP BY ALL) SELECT measure, unit, value, rank() OVER (PARTITION BY measure ORDER BY value DESC)::INTEGER AS rank, count(*) OVER (PARTITION BY measure) AS of FROM l")
def panel_ranks(spark, sf_dir):
    return records.panel_ranks(_panel(spark, sf_dir))


@query("panel_changes", f"WITH {_PANEL_SQL} SELECT measure, unit, year::INTEGER AS year, before, value FROM (SELECT *, lag(value) OVER (PARTITION BY measure, unit ORDER BY year) AS before FROM p) WHERE before <> value")
def panel_changes(spark, sf_dir):
    return records.change_points(_panel(spark, sf_dir))


@query("level_steps", f"WITH {_PANEL_SQL} SELECT measure || '/' || CAST(unit AS VARCHAR) AS system, year::INTEGER AS since, lead(year) OVER (PARTITION BY measure, unit ORDER BY year)::INTEGER AS until, value AS level FROM p")
def level_steps(spark, sf_dir):
    announced = _panel(spark, sf_dir).select(F.concat("measure", F.lit("/"), F.col("unit").cast("string")).alias("system"), F.col("year").alias("at"), F.col("value").alias("level"))
    return records.steps(announced)


@query("citation_matrix", _LINKS_SQL + ", k AS (SELECT citing, cited, count(*) AS links FROM hosts WHERE cited <> '' GROUP BY citing, cited), top AS (SELECT h FROM (SELECT citing AS h, links FROM k UNION ALL SELECT cited, links FROM k) GROUP BY h ORDER BY sum(links) DESC, h LIMIT 30) SELECT citing, cited, links, round(links / sum(links) OVER (PARTITION BY citing), 4) AS share FROM k WHERE citing IN (SELECT h FROM top) AND cited IN (SELECT h FROM top)")
def citation_matrix(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    found = files.page_links(pages).select("page_id", scalar.host(F.col("url")).alias("cited")).filter("cited <> ''")
    links = found.join(pages.select("page_id", scalar.host(F.col("url")).alias("citing")), "page_id").groupBy("citing", "cited").agg(F.count("*").alias("links"))
    return records.citation_matrix(links)


@query("alias_votes", "WITH w AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS alias FROM lineitem), a AS (SELECT l_partkey AS alias, min(l_suppkey) AS actor FROM lineitem GROUP BY l_partkey), v AS (SELECT id, actor, count(DISTINCT alias) AS v FROM w JOIN a USING (alias) GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS r, lead(v) OVER w AS nx FROM v WINDOW w AS (PARTITION BY id ORDER BY v DESC, actor)) SELECT id, actor FROM r WHERE r = 1 AND (nx IS NULL OR (v >= 2 AND v >= 2 * nx))")
def alias_votes(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    return records.alias_vote(l.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("alias")).distinct(), l.groupBy(F.col("l_partkey").alias("alias")).agg(F.min("l_suppkey").alias("actor")))


@query("publisher_levels", "SELECT o_custkey AS subject, CASE min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 WHEN 'O' THEN 2 END) WHEN 0 THEN 'F' WHEN 1 THEN 'P' ELSE 'O' END AS level FROM orders WHERE o_orderstatus IN ('F', 'P', 'O') GROUP BY 1")
def publisher_levels(spark, sf_dir):
    return records.worst_level(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("status")), ["F", "P", "O"])


@query("partner_timeline", f"WITH {_CODES_SQL}, p AS (SELECT source, code AS partner, min(year) AS first, max(year) AS last, count(DISTINCT doc_id) AS docs FROM m WHERE year IS NOT NULL GROUP BY ALL) SELECT *, CASE WHEN first > 2016 THEN 'new' WHEN last <= 2016 THEN 'gone' ELSE 'kept' END AS state FROM p")
def partner_timeline(spark, sf_dir):
    rows = _codes(spark, sf_dir).filter("year is not null").withColumnRenamed("code", "partner")
    return records.timeline(rows, "source", 2019)


@query("jump_ranking", "SELECT n_name AS label, round(CASE WHEN lower(n_name) = 'nation_2' THEN 100 WHEN starts_with(lower(n_name), 'nation_2') THEN 80 ELSE 40 END - CASE WHEN n_nationkey % 2 = 0 THEN 10 ELSE 0 END + least(n_nationkey, 9) - length(n_name) / 100, 4)::DOUBLE AS points FROM nation WHERE contains(lower(n_name), 'nation_2')")
def jump_ranking(spark, sf_dir):
    points = records.jump_points(F.col("n_name"), "nation_2", F.col("n_nationkey"), F.col("n_nationkey") % 2 == 0)
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), F.round(points.cast("double"), 4).alias("points")).filter("points is not null")


@query("unit_blocks", "SELECT conv_id AS book, (turn // 3)::INTEGER AS unit, min(turn) + 1 AS first, max(turn) + 1 AS last, md5(string_agg(text, ' ' ORDER BY turn, text)) AS digest FROM conversations GROUP BY 1, 2")
def unit_blocks(spark, sf_dir):
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), (F.col("turn") + 1).alias("page"), "text")
    return records.unit_blocks(pages, 3).withColumn("digest", F.md5("text")).drop("text")


@query("library_freshness", "SELECT count_if(y IS NULL)::BIGINT AS only_ours, count_if(x IS NULL)::BIGINT AS only_theirs, count_if(x > y)::BIGINT AS ours_newer, count_if(y > x)::BIGINT AS theirs_newer, 'mixed' AS verdict FROM (SELECT o_orderkey AS k, o_custkey AS x FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k, o_custkey + o_orderkey % 5 - 2 AS y FROM orders WHERE o_orderkey % 4 <> 0) b USING (k)")
def library_freshness(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    ours = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("at"))
    theirs = o.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") + F.col("o_orderkey") % 5 - 2).alias("at"))
    return records.freshness(ours, theirs, "k", "at")


@query("host_parents", "SELECT page_id AS url_id, 'example' AS source FROM pages WHERE regexp_matches(lower(url), '^[a-z]+://([^/:?#]*\\.)?example\\.org([/:?#]|$)')")
def host_parents(spark, sf_dir):
    urls = read(spark, sf_dir, "pages").select(F.col("page_id").alias("url_id"), scalar.host(F.col("url")).alias("host"))
    homes = spark.createDataFrame([("example.org", "example"), ("example.com", "one"), ("example.com", "two")], "home string, source string")
    return records.longest_host(urls, homes)
