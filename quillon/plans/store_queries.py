"""Queries over schemas, catalogues, feeds, imports, notebooks, books and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillon.operators import stores
from quillon.plans.registry import query
from quillon.sources import records
from quillon.sources.library import documents, listed, read
from quillon.sources.records import RECORDS_SQL


@query("schema_migrated", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(NULL AS VARCHAR) AS region, n_regionkey AS extra FROM nation")
def schema_migrated(spark, sf_dir):
    old = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("extra"))
    return stores.migrated(old, StructType([StructField("id", LongType()), StructField("name", StringType()), StructField("region", StringType())]))


TAXONOMY = {"words": {"articles": {"en": ["the", "with"], "de": ["der", "und"], "fr": ["les"]}, "forms": {"en": ["tion"], "de": ["tiona*", "ung"]}}}


@query("scoped_terms", r"""WITH t(topic, term, english) AS (VALUES ('articles', 'the', TRUE), ('articles', 'with', TRUE), ('articles', 'der', FALSE), ('articles', 'und', FALSE), ('articles', 'les', FALSE), ('forms', 'tion', TRUE), ('forms', 'tiona*', FALSE), ('forms', 'ung', FALSE))
SELECT doc_id, topic, term FROM documents, t WHERE lang <> 'en' OR english""")
def scoped_terms(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", (F.col("lang") == "en").alias("english"))
    return stores.scoped_terms(docs, stores.catalogue(spark, TAXONOMY))


_FEED_SQL = "f AS (SELECT event_id AS id, 1995 + user_id % 30 AS year, 'A' || CAST(user_id % 7 AS VARCHAR) || '; B' || CAST(event_id % 5 AS VARCHAR) || ';' AS initiators, CASE WHEN event_id % 3 = 0 THEN 'C; C;D' || CAST(user_id % 4 AS VARCHAR) ELSE '' END AS receivers FROM events)"


@query("incident_feed", f"WITH {_FEED_SQL} SELECT * FROM (SELECT DISTINCT id AS event, year, 'initiator' AS role, trim(unnest(string_split(initiators, ';'))) AS name FROM f WHERE year >= 2000 UNION ALL SELECT DISTINCT id, year, 'receiver', trim(unnest(string_split(receivers, ';'))) FROM f WHERE year >= 2000) WHERE name <> ''")
def incident_feed(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    rows = read(spark, sf_dir, "events").select(e.alias("id"), (1995 + u % 30).alias("year"), F.concat(F.lit("A"), (u % 7).cast("string"), F.lit("; B"), (e % 5).cast("string"), F.lit(";")).alias("initiators"), F.when(e % 3 == 0, F.concat(F.lit("C; C;D"), (u % 4).cast("string"))).otherwise("").alias("receivers"))
    return stores.incidents(rows)


@query("conflict_feed", "SELECT event_id, CAST(floor(value) AS BIGINT) AS deaths FROM events WHERE floor(value) >= 50 AND event_id % 3 = 1 AND event_id % 5 BETWEEN 1 AND 3 AND user_id % 4 < 2")
def conflict_feed(spark, sf_dir):
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select("event_id", F.floor("value").alias("deaths"), (e % 3).alias("clarity"), (e % 5).alias("precision"), F.concat(F.lit("C"), (F.col("user_id") % 4).cast("string")).alias("country"))
    return stores.conflict_events(rows, ["C0", "C1"]).select("event_id", "deaths")


@query("item_feed", "SELECT event_id AS item FROM events WHERE user_id % 6 IN (1, 2) OR event_id % 40 IN (1, 2, 3) OR (event_id + 7) % 40 IN (1, 2, 3)")
def item_feed(spark, sf_dir):
    e = F.col("event_id")
    name = lambda n: F.concat(F.lit("Q"), n.cast("string"))
    items = read(spark, sf_dir, "events").select(e.alias("item"), F.concat(F.lit("C"), (F.col("user_id") % 6).cast("string")).alias("country"), F.array(name(e % 40), name((e + 7) % 40)).alias("participants"))
    known = spark.createDataFrame([("Q1",), ("Q2",), ("Q3",)], "actor string")
    return stores.wikidata_items(items, ["C1", "C2"], known).select("item")


@query("crawl_files", "WITH p AS (SELECT o_custkey AS page, 'S' || CAST(o_custkey % 5 AS VARCHAR) AS source, max(o_orderdate) AS crawled FROM orders GROUP BY 1, 2), l AS (SELECT DISTINCT o_custkey AS page, 'u' || CAST(l_partkey AS VARCHAR) AS url FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT min(source) AS source, url FROM p JOIN l USING (page) WHERE crawled < TIMESTAMP '2000-06-01' AND url NOT IN (SELECT 'u' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 4 = 0) GROUP BY url")
def crawl_files(spark, sf_dir):
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    pages = o.groupBy(F.col("o_custkey").alias("page"), F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string")).alias("source")).agg(F.max("o_orderdate").alias("crawled"))
    url = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    links = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("page"), url("l_partkey").alias("url")).distinct()
    return stores.crawl(pages, links, read(spark, sf_dir, "part").filter("p_partkey % 4 = 0").select(url("p_partkey").alias("url")), "2000-06-01")


@query("inbox_import", r"SELECT sha256(text) AS sha256, doc_id AS name, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 10 = 0) OR doc_id <> min(doc_id) OVER (PARTITION BY text) THEN 'duplicate' ELSE 'stored' END AS status, 'hand' AS by, doc_id % 3 = 1 AS official FROM documents WHERE doc_id % 2 = 1")
def inbox_import(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    url = F.when(F.col("doc_id") % 3 == 1, "https://www.gov.example/x.pdf").otherwise("https://mirror.elsewhere/x.pdf")
    inbox = docs.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("name"), F.col("text").alias("content"), url.alias("url"))
    have = docs.filter("doc_id % 10 = 0").select(F.sha2("text", 256).alias("sha256"))
    return stores.imported(inbox, have, "hand", spark.createDataFrame([("gov.example",)], "family string"))


@query("tier_panel", "SELECT n_name AS country, 1 + n_nationkey % 3 AS tier FROM nation")
def tier_panel(spark, sf_dir):
    per = read(spark, sf_dir, "nation").groupBy((F.col("n_nationkey") % 3).alias("t")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), "; ").alias("names"))
    report = per.select(F.concat(F.lit("Report\nTier "), (F.col("t") + 1).cast("string"), F.lit(": "), "names", F.lit("\nEnd")).alias("text"))
    return stores.tier_panel(report, ["Tier 1", "Tier 2", "Tier 3"])


@query("json_holds", "SELECT event_id FROM events WHERE event_id % 3 = 0")
def json_holds(spark, sf_dir):
    made = F.when(F.col("event_id") % 3 == 0, F.lit('{"Bear": 2, "Owl": 1}')).otherwise('{"Owl": 4}')
    return stores.holding(read(spark, sf_dir, "events").select("event_id", made.alias("names")), "Bear").select("event_id")


@query("random_sample", "SELECT doc_id FROM documents ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 40")
def random_sample(spark, sf_dir):
    return stores.sampled(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 40, 7)


_EVENTS = [(1, "tion", 2003), (2, "with the", 2010), (3, "ther", 2015)]


@query("event_mentions", RECORDS_SQL + r""", e(event, name, year) AS (VALUES (1, 'tion', 2003), (2, 'with the', 2010), (3, 'ther', 2015)), t AS (SELECT doc_id, year AS doc_year, CASE WHEN doc_id % 4 = 0 THEN 'In 1999 ' || left(text, 60) ELSE text END AS text FROM docs), m AS (SELECT event, doc_id, year, unnest(regexp_extract_all(text, '(?is)(.{0,80}\b' || name || '\b.{0,80})')) AS c FROM e JOIN t ON (doc_year IS NULL OR doc_year >= e.year) AND doc_id IN (SELECT doc_id FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS w FROM t) WHERE w = string_split(e.name, ' ')[1]))
SELECT DISTINCT event, doc_id FROM m WHERE len(list_filter(regexp_extract_all(c, '(^|[^0-9])((?:19|20)[0-9]{2})($|[^0-9])', 2), lambda y: CAST(y AS INTEGER) < year)) = 0""")
def event_mentions(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("In 1999 "), F.substring("text", 1, 60))).otherwise(F.col("text")).alias("text"), "year")
    return stores.event_mentions(docs, spark.createDataFrame(_EVENTS, "event int, name string, year int"))


@query("console_groups", "SELECT grouping, name, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY grouping ORDER BY n DESC, name)::INTEGER AS rank FROM (SELECT 'sources' AS grouping, source AS name, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'languages', 's-' || lang, count(*) FROM documents GROUP BY lang) WHERE starts_with(name, 's')) WHERE rank <= 3")
def console_groups(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return stores.console_groups({"sources": d.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")), "languages": d.groupBy(F.concat(F.lit("s-"), "lang").alias("name")).agg(F.count("*").alias("n"))}, "S")


@query("notebooks_merged", """SELECT url, sha256, max({'a': "at", 'n': note}).n AS note, max("at") AS "at" FROM (SELECT 'u' || CAST(doc_id % 50 AS VARCHAR) AS url, md5(lang) AS sha256, 'note ' || CAST(doc_id AS VARCHAR) AS note, doc_id % 97 AS "at" FROM documents) GROUP BY url, sha256""")
def notebooks_merged(spark, sf_dir):
    i = F.col("doc_id")
    notes = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("u"), (i % 50).cast("string")).alias("url"), F.md5("lang").alias("sha256"), F.concat(F.lit("note "), i.cast("string")).alias("note"), (i % 97).alias("at"))
    return stores.merged_notes(notes.filter("doc_id % 2 = 0").drop("doc_id"), notes.filter("doc_id % 2 = 1").drop("doc_id"))


@query("notes_cited", RECORDS_SQL + " SELECT 'n' || CAST(doc_id AS VARCHAR) AS note, source || ': ' || title || ' (' || coalesce(CAST(year AS VARCHAR), 'n.d.') || ')' || CASE WHEN doc_id % 3 = 0 THEN ', p. ' || CAST(1 + doc_id % 9 AS VARCHAR) ELSE '' END AS line FROM files")
def notes_cited(spark, sf_dir):
    docs = records.files(spark, sf_dir)
    i = F.col("doc_id")
    notes = docs.select(F.concat(F.lit("n"), i.cast("string")).alias("note"), "doc_id", F.when(i % 3 == 0, 1 + i % 9).alias("page"))
    return stores.cited(notes, docs.select("doc_id", "source", "title", "year"))


@query("attribution_totals", "SELECT 'Q' || CAST(1 + doc_id % 20 AS VARCHAR) AS actor, count(*) AS claims, count_if(doc_id % 4 <> 0)::BIGINT AS proven FROM documents WHERE 1 + doc_id % 20 <= 12 GROUP BY 1")
def attribution_totals(spark, sf_dir):
    i = F.col("doc_id")
    d = read(spark, sf_dir, "documents").select(i.alias("claim_id"), F.concat(F.lit("Q"), (1 + i % 20).cast("string")).alias("actor"), F.when(i % 4 != 0, 5).alias("place"))
    return stores.attributions(d.select("claim_id", "actor"), d.select("claim_id", "place"), records.actors(spark))


_BOOK_SQL = "p AS (SELECT DISTINCT conv_id AS book, turn + 1 AS page FROM conversations), c AS (SELECT book, page // 3 AS chapter, page AS first FROM p WHERE page % 3 = 0)"


@query("page_chapters", f"WITH {_BOOK_SQL} SELECT p.book, page, (SELECT max(chapter) FROM c WHERE c.book = p.book AND first <= page) AS chapter FROM p")
def page_chapters(spark, sf_dir):
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), (F.col("turn") + 1).alias("page")).distinct()
    return stores.chapters_of(pages, pages.filter("page % 3 = 0").select("book", F.floor(F.col("page") / 3).alias("chapter"), F.col("page").alias("first")))


@query("chapter_actors", f"WITH {_BOOK_SQL}, m AS (SELECT conv_id AS book, turn + 1 AS page, role AS actor FROM conversations) SELECT m.book, (SELECT max(chapter) FROM c WHERE c.book = m.book AND first <= page) AS chapter, actor, count(*) AS n FROM m GROUP BY 1, 2, 3")
def chapter_actors(spark, sf_dir):
    named = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), (F.col("turn") + 1).alias("page"), F.col("role").alias("actor"))
    pages = named.select("book", "page").distinct()
    return stores.actors_by_chapter(named, pages.filter("page % 3 = 0").select("book", F.floor(F.col("page") / 3).alias("chapter"), F.col("page").alias("first")))


@query("printed_contents", "SELECT doc_id, '1 Scope' AS title, 5 + doc_id % 9 AS page FROM documents UNION ALL SELECT doc_id, '2.1 Method and data', 40 FROM documents")
def printed_contents(spark, sf_dir):
    text = F.concat(F.lit("Contents\n1 Scope ....... "), (5 + F.col("doc_id") % 9).cast("string"), F.lit("\n2.1 Method and data .... 40\nno entry 12\n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(stores.printed_contents(text)).alias("x")).select("doc_id", "x.title", "x.page")


@query("index_entries", "SELECT doc_id, 'Novak, Jan' AS head, '12,14,15,16' AS pages FROM documents UNION ALL SELECT doc_id, 'Owl', CAST(1 + doc_id % 30 AS VARCHAR) FROM documents")
def index_entries(spark, sf_dir):
    text = F.concat(F.lit("Index\nNovak, Jan, 12, 14–16\nOwl, "), (1 + F.col("doc_id") % 30).cast("string"), F.lit("\nsee also Bear\n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(stores.index_entries(text)).alias("x")).select("doc_id", "x.head", F.array_join(F.transform("x.pages", lambda p: p.cast("string")), ",").alias("pages"))


@query("book_metadata", "SELECT p_partkey AS book, CASE WHEN p_partkey % 5 = 0 THEN 'hand' WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS title, CASE WHEN p_partkey % 5 = 0 THEN 'hand' WHEN p_partkey % 2 = 0 THEN 'register' ELSE 'file' END AS title_by, CAST(p_size AS VARCHAR) AS year, CASE WHEN p_partkey % 2 = 0 THEN 'register' ELSE 'file' END AS year_by FROM part")
def book_metadata(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    hand = p.filter("p_partkey % 5 = 0").select(k.alias("book"), F.lit("hand").alias("title"), F.lit(None).cast("int").alias("year"))
    register = p.filter("p_partkey % 2 = 0").select(k.alias("book"), F.col("p_brand").alias("title"), F.col("p_size").alias("year"))
    return stores.book_metadata([("hand", hand), ("register", register), ("file", p.select(k.alias("book"), F.col("p_name").alias("title"), F.col("p_size").alias("year")))], "book", ["title", "year"])


@query("page_labels", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'i' WHEN 1 THEN 'ii' WHEN 2 THEN '1' ELSE CAST(1 + doc_id % 5 AS VARCHAR) END AS label FROM documents")
def page_labels(spark, sf_dir):
    n = (1 + F.col("doc_id") % 5).cast("int")
    labels = F.create_map(*[F.lit(x) for pair in ((1, "i"), (2, "ii"), (3, "1")) for x in pair])
    return read(spark, sf_dir, "documents").select("doc_id", stores.page_label(labels, n).alias("label"))


@query("derived_kept", "SELECT doc_id, lang FROM documents WHERE doc_id % 7 <> 3")
def derived_kept(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    derived = d.select("doc_id", F.sha2("text", 256).alias("sha256"), "lang")
    changed = d.select("doc_id", F.when(F.col("doc_id") % 7 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return stores.invalidated(derived, changed).select("doc_id", "lang")


@query("verdicts_applied", "SELECT doc_id, doc_id % 6 = 2 AS accepted FROM documents WHERE doc_id % 6 <> 0")
def verdicts_applied(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    first = d.filter("doc_id % 2 = 0").select("doc_id", F.lit("rejected").alias("verdict"), F.lit(1).alias("at"))
    later = d.filter("doc_id % 6 in (2, 4)").select("doc_id", F.when(i % 6 == 2, "accepted").otherwise("open").alias("verdict"), F.lit(2).alias("at"))
    verdicts = first.unionByName(later)
    accepted = stores.with_verdicts(d, verdicts, ["doc_id"], accepted=True).withColumn("accepted", F.lit(True))
    return stores.with_verdicts(d, verdicts, ["doc_id"]).join(accepted, "doc_id", "left").na.fill(False, ["accepted"])


@query("hand_lists_merged", "SELECT o_custkey AS key, max({'a': o_orderkey // 8, 'p': CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END, 'v': o_orderkey}).v AS value, CASE WHEN max({'a': o_orderkey // 8, 'p': CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END, 'v': o_orderkey}).p = 1 THEN 'ours' ELSE 'theirs' END AS by FROM orders GROUP BY 1")
def hand_lists_merged(spark, sf_dir):
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), k.alias("value"), F.floor(k / 8).alias("at"))
    return stores.lists_merged(o.filter("value % 2 = 0"), o.filter("value % 2 = 1"))


@query("markdown_lines", "SELECT '| ' || n_name || ' | ' || CAST(n_regionkey AS VARCHAR) || ' |' AS value FROM nation")
def markdown_lines(spark, sf_dir):
    return stores.markdown_table(read(spark, sf_dir, "nation").select("n_name", "n_regionkey"))


@query("update_history", "SELECT 'check' AS step, count(*) AS n, '2024-01-31' AS at FROM pages UNION ALL SELECT 'download', count(*), '2024-01-31' FROM documents")
def update_history(spark, sf_dir):
    return stores.history_row({"check": read(spark, sf_dir, "pages"), "download": read(spark, sf_dir, "documents")}, "2024-01-31")


@query("usable_names", "WITH n(actor, name) AS (VALUES ('a', 'Abu Omar Baghdadi'), ('a', 'Northern Front'), ('c', 'Lazarus')) SELECT * FROM n")
def usable_names(spark, sf_dir):
    rows = [("a", "Abu Omar Baghdadi", "person", False), ("a", "Abu Omarsson", "person", False), ("a", "Northern Front", "armed", False), ("b", "Owl", "cyber", True), ("c", "Lazarus", "cyber", True), ("c", "Lazarussi", "cyber", False), ("d", "military", "cyber", True)]
    return stores.usable_names(spark.createDataFrame(rows, "actor string, name string, kind string, is_label boolean"), ["military"])


@query("layer_choices", "SELECT o_orderpriority AS layer, count(*) AS connecting, count_if(o_orderpriority <> '5-LOW')::BIGINT AS stated FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY 1")
def layer_choices(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ties = l.select(F.when(F.col("l_returnflag") == "R", "rival of").otherwise("sells").alias("rel"), F.when(F.col("o_orderpriority") == "5-LOW", "reports").otherwise(F.col("o_orderpriority")).alias("layer"))
    kept = stores.layer_choice(ties, "connecting")
    a = kept.groupBy("layer").agg(F.count("*").alias("connecting"))
    b = stores.layer_choice(kept, "stated").groupBy("layer").agg(F.count("*").alias("stated"))
    return a.join(b, "layer", "left").na.fill(0, ["stated"]).withColumn("layer", F.when(F.col("layer") == "reports", "5-LOW").otherwise(F.col("layer")))


@query("concept_names", "SELECT lower(n_name) AS key, 'k' || CAST(n_regionkey AS VARCHAR) || CASE WHEN n_nationkey % 4 = 0 THEN ',k9' ELSE '' END AS concepts FROM nation")
def concept_names(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    one = n.select(F.col("n_name").alias("name"), F.concat(F.lit("k"), F.col("n_regionkey").cast("string")).alias("concept"))
    return stores.concepts(one.unionByName(n.filter("n_nationkey % 4 = 0").select(F.concat(F.lit(" "), F.lower("n_name")).alias("name"), F.lit("k9").alias("concept"))))


@query("gazetteer_candidates", "WITH i AS (SELECT s_suppkey AS item, s_nationkey % 5 AS class, s_acctbal AS n FROM supplier), w AS (SELECT item, 'class' AS why, n FROM i WHERE class IN (1, 2) UNION ALL SELECT item, 'designated', n FROM i WHERE item % 3 = 0) SELECT item, why, rank FROM (SELECT *, row_number() OVER (PARTITION BY why ORDER BY n DESC, item)::INTEGER AS rank FROM w) WHERE rank <= 25")
def gazetteer_candidates(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), (F.col("s_nationkey") % 5).alias("class"), F.col("s_acctbal").alias("notability"))
    return stores.gazetteer(s, [1, 2], s.filter("item % 3 = 0").select("item"))


@query("graph_scope", RECORDS_SQL + " SELECT doc_id FROM listed_files WHERE indexed AND year BETWEEN 2005 AND 2015")
def graph_scope(spark, sf_dir):
    extra = records.files(spark, sf_dir).select("doc_id", "indexed")
    return listed(spark, sf_dir).join(extra, "doc_id").filter("indexed and year between 2005 and 2015").select("doc_id")


@query("counted_links", RECORDS_SQL + " SELECT country, '/documents?country=' || country || '&lang=en' AS link, count(*) AS n FROM listed WHERE lang = 'en' GROUP BY country")
def counted_links(spark, sf_dir):
    per = listed(spark, sf_dir).filter("lang = 'en'").groupBy("country").agg(F.count("*").alias("n"))
    links = spark.createDataFrame([(f"C{i}", stores.link_of({"country": f"C{i}", "year": None, "lang": "en"})) for i in range(6)], "country string, link string")
    return per.join(links, "country")


@query("report_page", RECORDS_SQL + " SELECT f.doc_id, title, source, country, (SELECT count(*) FROM doc_actors a WHERE a.doc_id = f.doc_id) AS actors, (SELECT count(DISTINCT code) FROM codes c WHERE c.doc_id = f.doc_id) AS codes, (SELECT count(*) FROM citations c WHERE c.doc_id = f.doc_id) AS cites, (SELECT count(*) FROM files o WHERE o.work_id = f.work_id AND o.doc_id <> f.doc_id) AS other_files FROM listed_files f")
def report_page(spark, sf_dir):
    n = lambda df, key, name: df.groupBy(F.col(key).alias("doc_id")).agg(F.count("*").alias(name))
    every = records.files(spark, sf_dir).select("doc_id", "title", "work_id")
    page = listed(spark, sf_dir).select("doc_id", "source", "country").join(every, "doc_id")
    same = every.filter("work_id is not null").groupBy("work_id").agg((F.count("*") - 1).alias("other_files"))
    named = records.doc_actors(records.mentions(spark, sf_dir))
    page = page.join(n(named, "doc_id", "actors"), "doc_id", "left").join(n(records.codes(spark, sf_dir).select("doc_id", "code").distinct(), "doc_id", "codes"), "doc_id", "left").join(n(records.citations(spark, sf_dir), "doc_id", "cites"), "doc_id", "left").join(same, "work_id", "left")
    return page.na.fill(0, ["actors", "codes", "cites", "other_files"]).select("doc_id", "title", "source", "country", "actors", "codes", "cites", "other_files")
