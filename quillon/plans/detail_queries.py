"""Queries over rules that complete others: clamped pages, unspaced scripts, passages, scoped pairs, cascades, works by keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import rules, scalar
from quillon.operators import dating, facets, graph, scope, text, works
from quillon.plans.actor_queries import _SCOPED, _near
from quillon.plans.registry import query
from quillon.sources import records
from quillon.sources.library import LIBRARY_SQL, listed, read
from quillon.sources.records import RECORDS_SQL
from quillon.sources.shared import keep


@query("facet_last_page", LIBRARY_SQL + " SELECT doc_id FROM listed ORDER BY doc_id LIMIT 50 OFFSET (SELECT greatest(ceil(count(*) / 50), 1) * 50 - 50 FROM listed)")
def facet_last_page(spark, sf_dir):
    return facets.page(listed(spark, sf_dir), [F.col("doc_id")], 9_999).select("doc_id")


_MIXED = ["網絡攻擊和網絡安全", "الهجوم السيبراني والهجوم", "plain attack words attack", "кибератака на сеть", "Αθήνα abc"]


@query("unspaced_terms", "SELECT doc_id, topic, term, hits FROM (SELECT doc_id, doc_id % 5 AS m FROM documents) JOIN (VALUES (0, 'cyber', '網絡', 2), (1, 'cyber', 'هجوم', 2), (2, 'cyber', 'attack', 2)) v(k, topic, term, hits) ON k = m")
def unspaced_terms(spark, sf_dir):
    rows = F.array(*[F.lit(x) for x in _MIXED])
    docs = read(spark, sf_dir, "documents").select("doc_id", F.element_at(rows, (F.col("doc_id") % 5 + 1).cast("int")).alias("text"))
    return text.topic_hits(docs, spark.createDataFrame([("cyber", "網絡"), ("cyber", "هجوم"), ("cyber", "attack")], "topic string, term string"))


@query("scripts", "SELECT doc_id, ['han', 'arabic', 'latin', 'cyrillic', 'greek'][doc_id % 5 + 1] AS script FROM documents")
def scripts(spark, sf_dir):
    rows = F.array(*[F.lit(x) for x in _MIXED])
    return read(spark, sf_dir, "documents").select("doc_id", scalar.script_of(F.element_at(rows, (F.col("doc_id") % 5 + 1).cast("int"))).alias("script"))


@query("passages", r"""WITH p AS (SELECT doc_id, text, strpos(lower(text), 'tion ') - 1 AS s FROM documents), c AS (SELECT *, s + 4 AS e, greatest(s - 260, 0) AS l, least(s + 4 + 260, length(text)) AS r FROM p WHERE s >= 0),
x AS (SELECT *, substr(text, l + 1, s - l) AS b, substr(text, e + 1, r - e) AS a FROM c)
SELECT doc_id, CASE WHEN l > 0 THEN '…' || trim(regexp_replace(regexp_replace(b, '^\S*\s', ''), '\s+', ' ', 'g')) ELSE trim(regexp_replace(b, '\s+', ' ', 'g')) END AS before, substr(text, s + 1, 4) AS match, CASE WHEN r < length(text) THEN trim(regexp_replace(regexp_replace(a, '\s\S*$', ''), '\s+', ' ', 'g')) || '…' ELSE trim(regexp_replace(a, '\s+', ' ', 'g')) END AS after FROM x""")
def passages(spark, sf_dir):
    at = F.instr(F.translate("text", "TIİON", "tiion"), "tion ") - 1  # lower() would make two characters of İ
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", at.alias("s")).filter("s >= 0")
    return docs.select("doc_id", text.passage(F.col("text"), F.col("s"), F.col("s") + 4).alias("p")).select("doc_id", "p.before", "p.match", "p.after")


@query("pair_scope", _SCOPED + " SELECT a, b, count(DISTINCT doc_id) AS docs, count(DISTINCT source) AS publishers, min(year) AS first, max(year) AS last, sum(n)::BIGINT AS passages FROM near GROUP BY a, b")
def pair_scope(spark, sf_dir):
    pairs, docs, actors = _near(spark, sf_dir)
    rows = scope.pairs_after_founding(pairs, docs, actors)
    return rows.groupBy("a", "b").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("source").alias("publishers"), F.min("year").alias("first"), F.max("year").alias("last"), F.sum("n").alias("passages"))


@query("supplier_leads", "WITH e AS (SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS a, 'p' || CAST(l_partkey AS VARCHAR) AS b FROM lineitem), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT a AS w, 1 / ln(count(*)) AS v FROM n JOIN (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS node FROM part WHERE p_partkey % 5 <> 0) ON node = a GROUP BY a HAVING count(*) BETWEEN 2 AND 200) SELECT x.b AS a, y.b AS b, count(*) AS shared, round(sum(v), 6) AS score FROM n x JOIN n y ON x.a = y.a AND x.b < y.b JOIN w ON w.w = x.a WHERE NOT (x.b = 's1' AND y.b = 's2') GROUP BY x.b, y.b HAVING count(*) >= 2")
def supplier_leads(spark, sf_dir):
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    edges = read(spark, sf_dir, "lineitem").select(name("s", "l_suppkey").alias("a"), name("p", "l_partkey").alias("b"))
    kinds = read(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("node"), F.lit("actor").alias("kind")).unionByName(read(spark, sf_dir, "part").select(name("p", "p_partkey").alias("node"), F.when(F.col("p_partkey") % 5 == 0, "tool").otherwise("place").alias("kind")))
    return graph.named_leads(edges, kinds, spark.createDataFrame([("s1", "s2")], "a string, b string"), ["actor"], ["tool"], lambda df: keep(df, "leads"))


@query("actor_clusters")
def actor_clusters(spark, sf_dir):
    held = records.mentions(spark, sf_dir).select(F.col("doc_id").alias("basket"), F.col("actor").alias("item")).distinct()
    near = graph.associations(held).select(F.lit("all").alias("grouped"), "a", "b", F.col("npmi").alias("similarity"))
    return graph.clusters(near, "grouped", 0.1)


@query("union_counts", RECORDS_SQL + " SELECT kind, count(*) AS docs FROM (SELECT DISTINCT 'code' AS kind, doc_id FROM codes UNION SELECT DISTINCT 'technique', doc_id FROM techniques UNION SELECT 'either', doc_id FROM codes UNION SELECT 'either', doc_id FROM techniques) GROUP BY kind")
def union_counts(spark, sf_dir):
    c, t = records.codes(spark, sf_dir).select("doc_id"), records.techniques(spark, sf_dir).select("doc_id")
    of = lambda df, kind: df.select(F.lit(kind).alias("kind"), "doc_id")
    return of(c, "code").unionByName(of(t, "technique")).unionByName(of(c, "either")).unionByName(of(t, "either")).distinct().groupBy("kind").agg(F.count("*").alias("docs"))


_CASCADE_SQL = "f AS (SELECT doc_id, source, doc_id % 40 AS folder, doc_id // 8 AS title_key, lang, CASE WHEN doc_id % 7 = 0 THEN 2000 + doc_id % 20 END AS by_address, CASE WHEN doc_id % 5 = 0 THEN 2000 + doc_id % 15 END AS by_heading FROM documents), g AS (SELECT *, coalesce(by_address, by_heading) AS year FROM f)"


@query("dating_five_rules", f"""WITH {_CASCADE_SQL}, v AS (SELECT a.doc_id, min(b.year) AS y FROM g a JOIN g b ON a.source = b.source AND a.title_key = b.title_key AND a.folder = b.folder AND a.doc_id <> b.doc_id WHERE a.year IS NULL AND b.year IS NOT NULL AND (SELECT count(*) = count(DISTINCT lang) FROM g z WHERE z.source = a.source AND z.title_key = a.title_key AND z.folder = a.folder) GROUP BY a.doc_id HAVING count(*) >= 2 AND min(b.year) = max(b.year)),
o AS (SELECT a.doc_id, min(b.year) AS y FROM g a JOIN g b ON a.source = b.source AND a.folder = b.folder AND a.doc_id <> b.doc_id WHERE a.year IS NULL AND b.year IS NOT NULL GROUP BY a.doc_id HAVING count(*) >= 3 AND min(b.year) = max(b.year))
SELECT g.doc_id, coalesce(by_address, by_heading, v.y, o.y, 2000 + g.doc_id % 3)::BIGINT AS year, CASE WHEN by_address IS NOT NULL THEN 'address' WHEN by_heading IS NOT NULL THEN 'heading' WHEN v.y IS NOT NULL THEN 'versions' WHEN o.y IS NOT NULL THEN 'folder' ELSE 'publication date' END AS evidence FROM g LEFT JOIN v USING (doc_id) LEFT JOIN o ON o.doc_id = g.doc_id""")
def dating_five_rules(spark, sf_dir):
    i = F.col("doc_id")
    year = lambda m: (2000 + i % m).cast("string")
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", (i % 40).alias("folder"), F.floor(i / 8).alias("title_key"), "lang", F.lit(None).cast("string").alias("kind"),
        rules.address_year(F.when(i % 7 == 0, F.concat(F.lit("https://x.org/get?file=report-"), year(20), F.lit(".pdf"))).otherwise("https://x.org/a.pdf"), 2030).cast("long").alias("by_address"),
        rules.covered_year(F.when(i % 5 == 0, F.concat(F.lit("Annual report "), year(15))).otherwise("Some words"), 2030).cast("long").alias("by_heading"),
        (2000 + i % 3).alias("published"))
    docs = docs.withColumn("year", F.coalesce("by_address", "by_heading"))
    docs = dating.from_folder(dating.from_versions(docs))
    given = docs.withColumns({"versions_year": F.when(F.col("year").isNull(), F.col("versions_year")), "folder_year": F.when(F.col("year").isNull(), F.col("folder_year"))}).drop("year")
    return given.select("doc_id", *dating.estimate([("address", "by_address"), ("heading", "by_heading"), ("versions", "versions_year"), ("folder", "folder_year"), ("publication date", "published")]))


@query("works_by_keys", """WITH RECURSIVE f AS (SELECT doc_id AS id, source, lang, length(text) AS chars, CASE WHEN doc_id % 6 < 2 THEN doc_id // 6 END AS address, CASE WHEN doc_id % 6 IN (1, 2) THEN doc_id // 6 END AS title, CASE WHEN doc_id % 12 = 8 THEN doc_id // 12 WHEN doc_id % 12 = 2 THEN doc_id // 12 END AS edition FROM documents),
e AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.id <> b.id AND a.source = b.source AND (a.address = b.address OR a.title = b.title) UNION SELECT a.id, b.id FROM f a JOIN f b ON a.id <> b.id AND a.edition = b.edition),
r(node, seen) AS (SELECT id, id FROM f UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node WHERE r.seen < e.b), l AS (SELECT node AS id, min(seen) AS c FROM r GROUP BY node)
SELECT l.id, w.work_id FROM l JOIN (SELECT c, arg_max(f.id, {'w': chars * CASE WHEN lang = 'en' THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END, 'i': -f.id}) AS work_id FROM l JOIN f ON f.id = l.id GROUP BY c) w USING (c)""")
def works_by_keys(spark, sf_dir):
    i = F.col("doc_id")
    sixth, twelfth = F.floor(i / 6), F.floor(i / 12)
    held = read(spark, sf_dir, "documents").select(i.alias("id"), "source", "lang", F.length("text").alias("chars"), F.when(i % 6 < 2, sixth).alias("address"), F.when((i % 6).isin(1, 2), sixth).alias("title"), F.when((i % 12).isin(2, 8), twelfth).alias("edition"))
    return works.group_works(held, [["edition"], ["source", "address"], ["source", "title"]], checkpoint=lambda df: keep(df, "works"))


@query("briefing_years", LIBRARY_SQL + " SELECT country, min(year) AS first, max(year) AS last, max({'n': n, 'y': -year}).y * -1 AS peak, max(n) AS peak_docs FROM (SELECT country, year, count(*) AS n FROM listed WHERE year IS NOT NULL GROUP BY country, year) GROUP BY country")
def briefing_years(spark, sf_dir):
    per = listed(spark, sf_dir).filter("year is not null").groupBy("country", "year").agg(F.count("*").alias("n"))
    return per.groupBy("country").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.max_by("year", F.struct("n", -F.col("year"))).alias("peak"), F.max("n").alias("peak_docs"))


@query("watch_feed", LIBRARY_SQL + " SELECT query, doc_id, CAST(added AS VARCHAR) AS added, place FROM (SELECT query, doc_id, added, row_number() OVER (PARTITION BY query ORDER BY added DESC, doc_id DESC)::INTEGER AS place FROM (SELECT 'english' AS query, doc_id, added FROM listed WHERE lang = 'en' UNION ALL SELECT 'recent', doc_id, added FROM listed WHERE year >= 2015)) WHERE place <= 8")
def watch_feed(spark, sf_dir):
    from quillon.operators.relational import top_k

    docs = listed(spark, sf_dir)
    hits = F.explode(F.array_compact(F.array(F.when(F.col("lang") == "en", "english"), F.when(F.col("year") >= 2015, "recent")))).alias("query")
    rows = docs.select(hits, "doc_id", "added")
    return top_k(rows, ["query"], [F.desc("added"), F.desc("doc_id")], 8, "place").select("query", "doc_id", F.col("added").cast("string").alias("added"), "place")


