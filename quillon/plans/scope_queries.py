"""Queries over facets of records and over ranked search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import scope, text
from quillon.plans.library_queries import TOPIC_SQL, tagged
from quillon.plans.registry import query
from quillon.sources import records
from quillon.sources.library import documents, listed, read, sources, tokens
from quillon.sources.records import RECORDS_SQL


def _tables(spark, sf_dir) -> dict:
    """The records as a mapping that builds what is asked for only."""

    class Lazy(dict):
        def __missing__(self, name):
            marks = lambda: records.mentions(spark, sf_dir)
            make = {
                "actors": lambda: records.actors(spark),
                "doc_actors": lambda: records.doc_actors(marks()),
                "pairs": lambda: records.actor_pairs(marks()),
                "near_codes": lambda: scope.near_marks(records.codes(spark, sf_dir), marks()),
                "documents": lambda: documents(spark, sf_dir),
                "sources": lambda: sources(spark, sf_dir).select("source", "country", "publisher"),
            }
            self[name] = make[name]() if name in make else getattr(records, name)(spark, sf_dir)
            return self[name]

    return Lazy()


def _listed_files(spark, sf_dir):
    extra = records.files(spark, sf_dir).select("doc_id", "title", "work_id", "indexed")
    return listed(spark, sf_dir).join(extra, "doc_id")


def _facet(name: str, facets: scope.Facets, condition: str):
    work = "" if facets.all_files or facets.series else " AND (work_id IS NULL OR work_id = doc_id)"

    @query(name, f"{RECORDS_SQL} SELECT doc_id FROM listed_files f WHERE {condition}{work}")
    def run(spark, sf_dir):
        return scope.narrow(_listed_files(spark, sf_dir), facets, _tables(spark, sf_dir)).select("doc_id")

    return run


_FOUNDED = "(since IS NULL OR f.year IS NULL OR f.year >= since)"
_CITED = "doc_id IN (SELECT c.doc_id FROM citations c JOIN docs o ON o.doc_id = c.doc_id JOIN sources t ON t.source = c.to_source WHERE t.source <> o.source"
_facet("facet_primary", scope.Facets(), "TRUE")
_facet("facet_indexed", scope.Facets(indexed=True, all_files=True), "indexed")
_facet("facet_official", scope.Facets(official=True), "publisher = 'official'")
_facet("facet_source", scope.Facets(source="src3", all_files=True), "source = 'src3'")
_facet("facet_event", scope.Facets(event=4), "doc_id IN (SELECT doc_id FROM event_docs WHERE event = 4)")
_facet("facet_actor", scope.Facets(actor="Q6", all_files=True), f"EXISTS (SELECT 1 FROM doc_actors a JOIN actors USING (actor) WHERE a.doc_id = f.doc_id AND actor = 'Q6' AND {_FOUNDED})")
_facet("facet_series", scope.Facets(series="s6"), "doc_id IN (SELECT doc_id FROM editions WHERE series = 's6')")
_facet("facet_cluster", scope.Facets(cluster=("Q1", "Q2", "Q6"), all_files=True), "EXISTS (SELECT 1 FROM pairs p JOIN actors x ON x.actor = p.a JOIN actors y ON y.actor = p.b WHERE p.doc_id = f.doc_id AND p.a IN ('Q1', 'Q2', 'Q6') AND p.b IN ('Q1', 'Q2', 'Q6') AND (x.since IS NULL OR f.year IS NULL OR f.year >= x.since) AND (y.since IS NULL OR f.year IS NULL OR f.year >= y.since))")
_facet("facet_code_known", scope.Facets(cve="known"), "doc_id IN (SELECT doc_id FROM codes WHERE known_year IS NOT NULL)")
_facet("facet_code_age", scope.Facets(cve="age:3", all_files=True), "EXISTS (SELECT 1 FROM codes c WHERE c.doc_id = f.doc_id AND greatest(-1, least(10, f.year - c.code_year)) = 3 AND f.year IS NOT NULL)")
_facet("facet_code_before", scope.Facets(cve="known:before", all_files=True), "EXISTS (SELECT 1 FROM codes c WHERE c.doc_id = f.doc_id AND f.year < known_year)")
_facet("facet_code", scope.Facets(cve="cve-2007-1002", all_files=True), "doc_id IN (SELECT doc_id FROM codes WHERE code = 'CVE-2007-1002')")
_facet("facet_technique", scope.Facets(technique="T1017", all_files=True), "doc_id IN (SELECT doc_id FROM techniques WHERE technique = 'T1017')")
_facet("facet_tactic", scope.Facets(technique="tactic:tactic2"), "doc_id IN (SELECT doc_id FROM techniques WHERE tactic = 'tactic2')")
_facet("facet_cites_doc", scope.Facets(cite="doc:25", all_files=True), "doc_id IN (SELECT doc_id FROM citations WHERE to_doc = 25)")
_facet("facet_cited_by", scope.Facets(cite="by:51", all_files=True), "doc_id IN (SELECT to_doc FROM citations WHERE doc_id = 51)")
_facet("facet_cites_source", scope.Facets(cite="src:src5", all_files=True), "doc_id IN (SELECT doc_id FROM citations WHERE to_source = 'src5')")
_facet("facet_cites_host", scope.Facets(cite="host:h4.org", all_files=True), "doc_id IN (SELECT doc_id FROM citations WHERE host = 'h4.org' AND to_doc IS NULL AND to_source IS NULL)")
_facet("facet_cites_type", scope.Facets(cite="stype:commercial", all_files=True), _CITED + " AND publisher = 'commercial')")
_facet("facet_cites_any", scope.Facets(cite="agency:any", all_files=True), _CITED + ")")
_facet("facet_cites_country", scope.Facets(cite="ccountry:C2", all_files=True), _CITED + " AND country = 'C2')")


@query("code_near_actor", f"{RECORDS_SQL} SELECT DISTINCT c.doc_id, code, actor FROM codes c JOIN mentions m ON m.doc_id = c.doc_id AND abs(m.start - c.start) <= 600")
def code_near_actor(spark, sf_dir):
    return scope.near_marks(records.codes(spark, sf_dir), records.mentions(spark, sf_dir))


_CONCEPTS = {"tion": ["attion", "ther", "tionth", "er"], "the": ["der", "les", "los"]}
_GROUPS = [["tion*", "ther"], ["the*", "der", "les", "los"]]


@query("query_expansion", f"""{RECORDS_SQL} SELECT doc_id FROM tokens GROUP BY doc_id HAVING bool_or(starts_with(token, 'tion') OR token = 'ther' OR starts_with(token, 'attion')) AND bool_or(starts_with(token, 'the') OR token IN ('der', 'les', 'los'))""")
def query_expansion(spark, sf_dir):
    return scope.search_any(tokens(documents(spark, sf_dir)), scope.expand_query(["tion", "the"], _CONCEPTS))


_HITS_SQL = RECORDS_SQL + """
, c AS (SELECT doc_id, token, count(*)::DOUBLE AS n FROM tokens GROUP BY ALL), l AS (SELECT doc_id, sum(n) AS len FROM c GROUP BY doc_id),
g AS (SELECT count(*) AS corpus, avg(len) AS a FROM l), d AS (SELECT token, count(*) AS df FROM c GROUP BY token),
scores AS (SELECT doc_id, round(sum(ln(1 + (corpus - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (n * 2.2::DOUBLE / (n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a)))), 6) AS score FROM c JOIN d USING (token) JOIN l USING (doc_id), g WHERE token IN ('tion', 'ther') GROUP BY doc_id),
hits AS (SELECT f.doc_id, work_id, coalesce(score, 0) AS score, CASE WHEN lower(title) = 'tion' THEN 0 WHEN contains(lower(title), 'tion') THEN 1 WHEN score IS NOT NULL THEN 2 WHEN contains(lower(source), 'tion') THEN 3 END AS priority,
  CASE WHEN lower(title) = 'tion' THEN 'Exact title' WHEN contains(lower(title), 'tion') THEN 'Title' WHEN score IS NOT NULL THEN CASE WHEN f.doc_id IN (SELECT doc_id FROM tokens WHERE token = 'tion') THEN 'Indexed text' ELSE 'Expanded search term' END ELSE 'Publisher name' END AS reason
  FROM files f LEFT JOIN scores s ON s.doc_id = f.doc_id)"""


def _hits(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return scope.ranked_hits(records.files(spark, sf_dir).select("doc_id", "title", "source", "work_id"), "tion", text.bm25(docs, ["tion", "ther"]), text.search(tokens(docs), ["tion"]))


@query("search_reasons", _HITS_SQL + " SELECT doc_id, priority, score, reason FROM hits WHERE priority IS NOT NULL")
def search_reasons(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", "priority", "score", "reason")


@query("search_order", _HITS_SQL + " SELECT doc_id, row_number() OVER (ORDER BY priority, score DESC, work_id IS NOT NULL AND work_id <> doc_id, doc_id)::INTEGER AS place FROM hits WHERE priority IS NOT NULL ORDER BY place LIMIT 100")
def search_order(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    top = hits.orderBy(*scope.relevance(hits)).limit(100)  # a page of hits, which the window then numbers
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(*scope.relevance(hits)))).select("doc_id", "place")


@query("search_best_editions", _HITS_SQL + " SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY coalesce(work_id, doc_id) ORDER BY priority, score DESC, work_id IS NOT NULL AND work_id <> doc_id, doc_id) AS p FROM hits WHERE priority IS NOT NULL AND doc_id % 4 <> 0) WHERE p = 1")
def search_best_editions(spark, sf_dir):
    return scope.best_editions(_hits(spark, sf_dir).filter("doc_id % 4 <> 0")).select("doc_id")


@query("topic_score_order", TOPIC_SQL + " SELECT l.doc_id, round(sum(score), 2) AS score FROM listed l JOIN tagged USING (doc_id) WHERE topic IN ('articles', 'endings') GROUP BY l.doc_id HAVING count(*) = 2")
def topic_score_order(spark, sf_dir):
    return scope.by_topic_scores(listed(spark, sf_dir), tagged(spark, sf_dir), ["articles", "endings"])


@query("low_relevance_pages", r"""SELECT page_id, regexp_matches(lower(url), '\.(jpe?g|png|gif|css|js|zip|exe)($|[?#])|/(login|search|cart)\b') OR regexp_matches(lower(t), '\b(privacy|cookie|terms of use|tender|procurement|job|vacancy|careers|invoice|agenda)\b') AS low,
array_to_string(list_slice(string_split(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\.', ''), '.'), -2, -1), '.') IN ('example.com', 'example.org') AS own
FROM (SELECT *, CASE page_id % 4 WHEN 0 THEN 'Job vacancy' WHEN 1 THEN 'Agenda' ELSE 'Report' END AS t FROM pages)""")
def low_relevance_pages(spark, sf_dir):
    title = F.when(F.col("page_id") % 4 == 0, "Job vacancy").when(F.col("page_id") % 4 == 1, "Agenda").otherwise("Report")
    return read(spark, sf_dir, "pages").select("page_id", scope.low_relevance(title, F.col("url")).alias("low"), scope.same_family(F.col("url"), F.array(F.lit("example.com"), F.lit("example.org"))).alias("own"))


@query("work_members", f"{RECORDS_SQL} SELECT work_id, doc_id, row_number() OVER (PARTITION BY work_id ORDER BY doc_id <> work_id, lang, doc_id)::INTEGER AS place FROM files WHERE work_id IS NOT NULL")
def work_members(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("work_id").orderBy(F.col("doc_id") != F.col("work_id"), "lang", "doc_id")
    return records.files(spark, sf_dir).filter("work_id is not null").select("work_id", "doc_id", F.row_number().over(w).alias("place"))


_TIES_SQL = "SELECT o_custkey AS a, l_partkey AS b, CASE l_linenumber % 3 WHEN 0 THEN 'rival of' WHEN 1 THEN 'supplies' ELSE 'owns' END AS rel, o_orderpriority AS layer, l_quantity AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query("graph_tie_filter", f"SELECT a, b, rel, layer, weight FROM ({_TIES_SQL}) WHERE layer = '1-URGENT' AND weight >= 30 AND rel NOT IN ('rival of') AND (a = 7 OR b = 7)")
def graph_tie_filter(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    ties = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ties = ties.select(F.col("o_custkey").alias("a"), F.col("l_partkey").alias("b"), F.when(n == 0, "rival of").when(n == 1, "supplies").otherwise("owns").alias("rel"), F.col("o_orderpriority").alias("layer"), F.col("l_quantity").alias("weight"))
    return scope.graph_ties(ties, entity=7, layer="1-URGENT", least=30, not_a_tie=("rival of",))


@query("event_filter", "SELECT event_id, event_type FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND props ILIKE '%\"K\": 6%'")
def event_filter(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    first = events.agg(F.min("event_type")).first()[0]
    return scope.event_rows(events, first, "2024-01-05", "2024-01-20", '"K": 6').select("event_id", "event_type")
