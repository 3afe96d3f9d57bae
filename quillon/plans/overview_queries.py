"""Queries over editions of series, dashboards, events and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import editions, overview, scope
from quillon.plans.library_queries import TOPIC_SQL, tagged
from quillon.plans.registry import query
from quillon.sources import records
from quillon.sources.library import documents, listed, read, sources, tokens
from quillon.sources.records import RECORDS_SQL

_RECORDS_ONLY = RECORDS_SQL[len(RECORDS_SQL.split(", actors(actor")[0]) :]
_BOTH = TOPIC_SQL + _RECORDS_ONLY
_PROFILE_SQL = ", profile AS (SELECT series, year, max({'e': lang = 'en', 'c': length(text), 'd': -doc_id}).d * -1 AS doc_id FROM editions JOIN (SELECT doc_id, text FROM documents) USING (doc_id) GROUP BY series, year)"


def _profile(spark, sf_dir):
    return editions.profiles(records.editions(spark, sf_dir), documents(spark, sf_dir).select("doc_id", F.length("text").alias("chars")))


def _all_tags(spark, sf_dir):
    from quillon.operators import text
    from quillon.plans.library_queries import terms

    return text.classify(documents(spark, sf_dir), terms(spark))


_TAGGED_ALL = _BOTH.replace(" WHERE doc_id IN (SELECT doc_id FROM listed) GROUP BY ALL", " GROUP BY ALL").replace("FROM token_lists l JOIN listed USING (doc_id), terms t", "FROM token_lists l, terms t")


@query("edition_index", RECORDS_SQL + " SELECT doc_id, series, year, lang FROM editions")
def edition_index(spark, sf_dir):
    return editions.doc_index(records.editions(spark, sf_dir))


@query("edition_profiles", RECORDS_SQL + _PROFILE_SQL + " SELECT series, year, doc_id FROM profile")
def edition_profiles(spark, sf_dir):
    return _profile(spark, sf_dir)


@query("edition_topics", _TAGGED_ALL + _PROFILE_SQL + """, e AS (SELECT *, lag(year) OVER w AS before, lead(year) OVER w AS after FROM profile WINDOW w AS (PARTITION BY series ORDER BY year)), h AS (SELECT e.*, topic, score FROM e JOIN tagged USING (doc_id))
SELECT series, year, topic, score, CASE WHEN before IS NOT NULL AND EXISTS (SELECT 1 FROM h p WHERE p.series = h.series AND p.topic = h.topic AND p.year = h.before) THEN 'kept' ELSE 'in' END AS state FROM h
UNION ALL SELECT series, after, topic, 0, 'out' FROM h WHERE after IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h n WHERE n.series = h.series AND n.topic = h.topic AND n.year = h.after)""")
def edition_topics(spark, sf_dir):
    return editions.topic_years(_profile(spark, sf_dir), _all_tags(spark, sf_dir))


@query("edition_actors", RECORDS_SQL + _PROFILE_SQL + " SELECT series, year, actor, hits, year = min(year) OVER (PARTITION BY series, actor) AS new FROM profile JOIN doc_actors USING (doc_id)")
def edition_actors(spark, sf_dir):
    return editions.new_actors(_profile(spark, sf_dir), records.doc_actors(records.mentions(spark, sf_dir)))



@query("edition_diff_topics", TOPIC_SQL + """, o AS (SELECT topic, sum(score) AS score FROM tagged JOIN listed USING (doc_id) WHERE year = 2010 GROUP BY topic), n AS (SELECT topic, sum(score) AS score FROM tagged JOIN listed USING (doc_id) WHERE year = 2011 AND topic <> 'links' GROUP BY topic),
a AS (SELECT *, row_number() OVER (ORDER BY score DESC, topic) <= 3 AS m FROM o), b AS (SELECT *, row_number() OVER (ORDER BY score DESC, topic) <= 3 AS m FROM n)
SELECT coalesce(a.topic, b.topic) AS topic, CASE WHEN a.topic IS NULL THEN 'new' WHEN b.topic IS NULL THEN 'gone' WHEN b.m AND NOT a.m THEN 'up' WHEN a.m AND NOT b.m THEN 'down' ELSE 'same' END AS state, coalesce(round(a.score, 2), 0) AS old, coalesce(round(b.score, 2), 0) AS new FROM a FULL JOIN b ON a.topic = b.topic""")
def edition_diff_topics(spark, sf_dir):
    tags = tagged(spark, sf_dir).join(listed(spark, sf_dir).select("doc_id", "year"), "doc_id")
    per = lambda y: tags.filter(F.col("year") == y).groupBy("topic").agg(F.sum("score").alias("score"))
    found = editions.diff_topics(per(2010), per(2011).filter("topic <> 'links'"))
    return found.withColumns({"old": F.round("old", 2), "new": F.round("new", 2)})


@query("edition_diff_actors", RECORDS_SQL + """, o AS (SELECT actor, sum(hits) AS h FROM doc_actors JOIN docs USING (doc_id) WHERE year = 2010 AND doc_id % 2 = 0 GROUP BY actor), n AS (SELECT actor, sum(hits) AS h FROM doc_actors JOIN docs USING (doc_id) WHERE year = 2011 AND doc_id % 3 = 0 GROUP BY actor)
SELECT actor, state, old, new FROM (SELECT coalesce(o.actor, n.actor) AS actor, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'dropped' WHEN abs(n.h - o.h) >= 2 THEN 'changed' END AS state, coalesce(o.h, 0)::BIGINT AS old, coalesce(n.h, 0)::BIGINT AS new FROM o FULL JOIN n ON o.actor = n.actor) JOIN actors USING (actor) WHERE state IS NOT NULL AND kind <> 'country' AND lower(label) <> 'eron'""")
def edition_diff_actors(spark, sf_dir):
    rows = records.doc_actors(records.mentions(spark, sf_dir)).join(documents(spark, sf_dir).select("doc_id", "year"), "doc_id")
    per = lambda y, k: rows.filter((F.col("year") == y) & (F.col("doc_id") % k == 0)).groupBy("actor").agg(F.sum("hits").alias("hits"))
    return editions.diff_actors(per(2010, 2), per(2011, 3), records.actors(spark), own="Eron")


@query("series_curation", "SELECT source, lang AS key, count(*) AS files, CASE WHEN lang = 'en' THEN CASE WHEN min(doc_id) % 2 = 0 THEN 'rejected' ELSE 'confirmed' END ELSE 'open' END AS status FROM documents GROUP BY source, lang")
def series_curation(spark, sf_dir):
    proposed = read(spark, sf_dir, "documents").groupBy("source", F.col("lang").alias("key")).agg(F.count("*").alias("files"), F.min("doc_id").alias("first"))
    early = proposed.filter("key = 'en'").select("source", "key", F.lit("confirmed").alias("verdict"), F.lit(1).alias("at"))
    late = proposed.filter("key = 'en' and first % 2 = 0").select("source", "key", F.lit("rejected").alias("verdict"), F.lit(2).alias("at"))
    return editions.curated(proposed, early.unionByName(late)).drop("first")


_CELLS_SQL = """, span AS (SELECT series, min(year) AS since FROM editions GROUP BY series), cells AS (SELECT s.series, y.year, l.lang, CASE WHEN EXISTS (SELECT 1 FROM editions e WHERE e.series = s.series AND e.year = y.year AND e.lang = l.lang) THEN 'have' WHEN y.year >= 2024 THEN 'expected' ELSE 'missing' END AS state
FROM span s, (SELECT unnest(range(2000, 2026)) AS year) y, (SELECT unnest(['en', 'de']) AS lang) l WHERE y.year >= since),
hand AS (SELECT series, year, lang, CASE WHEN year % 7 = 0 THEN 'absent' WHEN year % 11 = 0 THEN 'have' ELSE state END AS state FROM cells)"""


def _cells(spark, sf_dir):
    from quillon.operators import works

    eds = records.editions(spark, sf_dir)
    known = eds.groupBy("series").agg(F.min("year").alias("since")).withColumn("langs", F.array(F.lit("en"), F.lit("de")))
    cells = works.editions(known, eds.withColumn("stored", F.lit(True)), 2025).withColumn("state", F.when((F.col("state") == "missing") & (F.col("year") >= 2024), "expected").otherwise(F.col("state")))
    mark = cells.select("series", "year", "lang")
    return editions.with_hand(cells, mark.filter("year % 7 = 0"), mark.filter("year % 11 = 0 and year % 7 <> 0"))


@query("edition_states", RECORDS_SQL + _CELLS_SQL + " SELECT series, year, lang, state FROM hand")
def edition_states(spark, sf_dir):
    return _cells(spark, sf_dir)


@query("editions_to_collect", RECORDS_SQL + _CELLS_SQL + """, w AS (SELECT *, row_number() OVER (PARTITION BY series, lang, state ORDER BY year) AS r FROM hand WHERE state IN ('missing', 'expected')), c AS (SELECT 's' || CAST(doc_id % 40 AS VARCHAR) AS series, year, lang, doc_id, row_number() OVER (PARTITION BY doc_id % 40, year, lang ORDER BY doc_id) AS r FROM docs WHERE doc_id % 3 = 1 AND year IS NOT NULL)
SELECT series, year, lang, state, coalesce((SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FROM c WHERE c.series = w.series AND c.year = w.year AND c.lang = w.lang AND c.r <= 8), '') AS candidates FROM w WHERE state = 'missing' OR r = 1""")
def editions_to_collect(spark, sf_dir):
    free = documents(spark, sf_dir).filter("doc_id % 3 = 1 and year is not null").select(F.concat(F.lit("s"), (F.col("doc_id") % 40).cast("string")).alias("series"), "year", "lang", "doc_id")
    return editions.to_collect(_cells(spark, sf_dir), free)


@query("pattern_addresses", "SELECT s AS source, 'https://' || s || '.example/' || l || '/report-' || CAST(y AS VARCHAR) || '.pdf' AS url, y::INTEGER AS year, l AS lang FROM (SELECT DISTINCT source AS s FROM documents), (SELECT unnest(range(2019, 2026)) AS y), (SELECT unnest(['en', 'fr']) AS l)")
def pattern_addresses(spark, sf_dir):
    own = read(spark, sf_dir, "documents").select("source").distinct()
    return editions.pattern_urls(own.select("source", F.concat(F.lit("https://"), "source", F.lit(".example/{lang}/report-{year}.pdf")).alias("pattern"), F.array(F.lit("en"), F.lit("fr")).alias("langs")), 2019, 2025)


@query("future_years", RECORDS_SQL + " SELECT doc_id, CASE WHEN year <= 2020 THEN year END AS year FROM docs")
def future_years(spark, sf_dir):
    return editions.past_years(documents(spark, sf_dir).select("doc_id", "year"), 2020)


@query("term_trend", RECORDS_SQL + ", h AS (SELECT DISTINCT doc_id FROM tokens WHERE token = 'with' OR starts_with(token, 'ther')), p AS (SELECT year, count(*) AS total, count_if(doc_id IN (SELECT doc_id FROM h)) AS docs FROM listed GROUP BY year) SELECT y.year, coalesce(docs, 0)::BIGINT AS docs, coalesce(total, 0) AS total, CASE WHEN total > 0 THEN round(docs / total, 4) ELSE 0 END AS share FROM (SELECT unnest(range(2000, 2026)) AS year) y LEFT JOIN p USING (year)")
def term_trend(spark, sf_dir):
    return overview.term_trend(tokens(documents(spark, sf_dir)), listed(spark, sf_dir).select("doc_id", "year"), ["with", "ther*"], 2000, 2025)


@query("home_totals", RECORDS_SQL + " SELECT count(*) AS total, count(DISTINCT source) AS agencies, count(DISTINCT country) AS countries, count(DISTINCT lang) AS langs, count_if(year IS NULL)::BIGINT AS undated, count_if(added BETWEEN DATE '2024-01-20' - 6 AND DATE '2024-01-20')::BIGINT AS added_7, count_if(added BETWEEN DATE '2024-01-20' - 29 AND DATE '2024-01-20')::BIGINT AS added_30, count_if(added BETWEEN DATE '2024-01-20' - 89 AND DATE '2024-01-20')::BIGINT AS added_90 FROM listed")
def home_totals(spark, sf_dir):
    return overview.dashboard(listed(spark, sf_dir), "2024-01-20")


@query("home_daily", RECORDS_SQL + " SELECT CAST(d AS VARCHAR) AS day, (SELECT count(*) FROM listed WHERE added = d) AS n FROM (SELECT DATE '2024-01-10' + CAST(unnest(range(-29, 1)) AS INTEGER) AS d)")
def home_daily(spark, sf_dir):
    return overview.daily(listed(spark, sf_dir), "2024-01-10").withColumn("day", F.col("day").cast("string"))


@query("home_years", RECORDS_SQL + " SELECT year, publisher, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY year), 4) AS share FROM listed WHERE year IS NOT NULL GROUP BY year, publisher")
def home_years(spark, sf_dir):
    return overview.year_split(listed(spark, sf_dir))


@query("home_newest", RECORDS_SQL + " SELECT doc_id FROM listed ORDER BY added DESC, doc_id DESC LIMIT 12")
def home_newest(spark, sf_dir):
    return overview.newest(listed(spark, sf_dir)).select("doc_id")


@query("event_markers", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('month', ts) ORDER BY value DESC, event_id)::INTEGER AS rank FROM events WHERE year(ts) = 2024 AND event_type IN ('error', 'purchase')) WHERE rank <= 3")
def event_markers(spark, sf_dir):
    return overview.markers(read(spark, sf_dir, "events"), (2024, 2024), ["error", "purchase"]).withColumn("day", F.col("day").cast("string"))


@query("event_facets", "SELECT 'kind' AS facet, event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), count(*) FROM events GROUP BY 2")
def event_facets(spark, sf_dir):
    return overview.event_facets(read(spark, sf_dir, "events"))


@query("event_lanes", "SELECT event_type AS lane, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY value DESC, event_id)::INTEGER AS place FROM events) WHERE place <= 5")
def event_lanes(spark, sf_dir):
    return overview.lanes(read(spark, sf_dir, "events")).withColumn("day", F.col("day").cast("string"))


@query("event_reports", RECORDS_SQL + " SELECT event, count(DISTINCT e.doc_id) AS reports, count(DISTINCT source) AS agencies FROM event_docs e JOIN listed_files f USING (doc_id) WHERE work_id IS NULL OR work_id = doc_id GROUP BY event")
def event_reports(spark, sf_dir):
    extra = records.files(spark, sf_dir).select("doc_id", "work_id")
    return overview.event_reports(records.event_docs(spark, sf_dir), scope.canonical(listed(spark, sf_dir).join(extra, "doc_id")))


@query("actor_events", "SELECT actor, event_id, role, rank FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY ts DESC, event_id)::INTEGER AS rank FROM (SELECT event_id, user_id % 20 AS actor, min(CASE WHEN event_id % 2 = 0 THEN 'source' ELSE 'target' END) AS role, any_value(ts) AS ts FROM events GROUP BY 1, 2)) WHERE rank <= 10")
def actor_events(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return overview.actor_events(events, events.select("event_id", (F.col("user_id") % 20).alias("actor"), F.when(F.col("event_id") % 2 == 0, "source").otherwise("target").alias("role")))


@query("event_months", "SELECT strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m') = (SELECT strftime(max(ts), '%Y-%m') FROM events) AS preliminary, round(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 2) AS error, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 2) AS purchase FROM events GROUP BY 1, 2")
def event_months(spark, sf_dir):
    return overview.month_totals(read(spark, sf_dir, "events"), ["error", "purchase"])


@query("superseded_months", "SELECT o_orderkey AS k, o_orderkey % 3 = 0 AND o_orderkey % 6 <> 0 AS preliminary, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 1")
def superseded_months(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders")
    old = orders.filter(k % 2 == 1).select(k.alias("k"), (k % 3 == 0).alias("preliminary"), F.lit("old").alias("version"))
    new = orders.filter(k % 3 == 0).select(k.alias("k"), (k % 6 != 0).alias("preliminary"), F.lit("new").alias("version"))
    return overview.supersede(old, new, "k")


@query("update_plan", "SELECT o_custkey AS source, count(*) AS pages, count_if(o_orderstatus = 'P' OR o_orderdate < TIMESTAMP '2000-01-01')::BIGINT AS stale, count(*) * 10.0::DOUBLE AS seconds FROM orders GROUP BY 1 HAVING count_if(o_orderstatus = 'P' OR o_orderdate < TIMESTAMP '2000-01-01') > 0")
def update_plan(spark, sf_dir):
    pages = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("crawled"))
    return overview.update_plan(pages, "2000-01-01")


@query("page_seconds", "SELECT source, CASE WHEN sum(p) >= 20 THEN round(sum(s) / sum(p), 4) ELSE 10 END AS seconds FROM (SELECT o_custkey AS source, o_orderkey % 9 AS p, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 5 GROUP BY source")
def page_seconds(spark, sf_dir):
    crawls = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("at"), (F.col("o_orderkey") % 9).alias("pages"), F.col("o_totalprice").alias("seconds"))
    return overview.seconds_per_page(crawls)


@query("source_states", "SELECT o_custkey AS source, ['error', 'blocked', 'never', 'skipped', 'ok'][min(list_position(['error', 'blocked', 'never', 'skipped', 'ok'], s))] AS state FROM (SELECT o_custkey, CASE o_orderkey % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'blocked' WHEN 2 THEN 'never' WHEN 3 THEN 'skipped' ELSE 'ok' END AS s FROM orders) GROUP BY 1")
def source_states(spark, sf_dir):
    n = F.col("o_orderkey") % 7
    state = F.when(n == 0, "error").when(n == 1, "blocked").when(n == 2, "never").when(n == 3, "skipped").otherwise("ok")
    return overview.source_states(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), state.alias("state")))


@query("list_page", RECORDS_SQL + ", p AS (SELECT * FROM listed_files WHERE work_id IS NULL OR work_id = doc_id) SELECT 'total' AS what, '' AS value, count(*) AS n FROM p UNION ALL SELECT 'type', coalesce(doc_type, 'none'), count(*) FROM p GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'other files', '', (SELECT count(*) FROM listed_files) - count(*) FROM p")
def list_page(spark, sf_dir):
    extra = records.files(spark, sf_dir).select("doc_id", "work_id")
    every = listed(spark, sf_dir).join(extra, "doc_id")
    return overview.list_page(scope.canonical(every), every)


@query("figures_traced", RECORDS_SQL + " SELECT country, count(*) AS shown, count(*) AS counted, TRUE AS ok FROM listed GROUP BY country")
def figures_traced(spark, sf_dir):
    from quillon.operators import facets

    docs = listed(spark, sf_dir)
    shown = docs.groupBy("country").agg(F.count("*").alias("n"))
    parts = [facets.apply(docs, facets.Filters(country=c)).agg(F.lit(c).alias("country"), F.count("*").alias("n")) for c in ("C0", "C1", "C2", "C3", "C4", "C5")]
    counted = parts[0]
    for p in parts[1:]:
        counted = counted.unionByName(p)
    return overview.figures(shown, counted, "country").filter("shown is not null or counted > 0")


@query("view_counts", RECORDS_SQL + " SELECT 'reports' AS view, count(*) AS n FROM listed UNION ALL SELECT 'actors', count(*) FROM actors UNION ALL SELECT 'events', (SELECT count(*) FROM events) UNION ALL SELECT 'codes', count(DISTINCT code) FROM codes")
def view_counts(spark, sf_dir):
    return overview.view_counts({"reports": listed(spark, sf_dir), "actors": records.actors(spark), "events": read(spark, sf_dir, "events"), "codes": records.codes(spark, sf_dir).select("code").distinct()})


@query("main_topics_by_day", TOPIC_SQL + ", c AS (SELECT CAST(added AS VARCHAR) AS added, topic, count(*) AS n FROM tagged JOIN listed USING (doc_id) WHERE rank <= 3 GROUP BY ALL) SELECT added, topic, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY added ORDER BY n DESC, topic)::INTEGER AS rank FROM c) WHERE rank <= 2")
def main_topics_by_day(spark, sf_dir):
    rows = tagged(spark, sf_dir).filter("rank <= 3").join(listed(spark, sf_dir).select("doc_id", F.col("added").cast("string").alias("added")), "doc_id")
    return overview.main_items(rows, "added", "topic", 2)


@query("topic_points", TOPIC_SQL + " SELECT topic, sum(CASE WHEN rank <= 2 THEN 3 ELSE 1 END)::BIGINT AS points, count(*) AS docs FROM tagged GROUP BY topic")
def topic_points(spark, sf_dir):
    return overview.topic_points(tagged(spark, sf_dir), main=2)


@query("category_totals", TOPIC_SQL + " SELECT CASE WHEN topic = 'endings' THEN 'forms' ELSE 'words' END AS category, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tagged GROUP BY 1")
def category_totals(spark, sf_dir):
    return overview.category_totals(tagged(spark, sf_dir), spark.createDataFrame([("articles", "words"), ("links", "words"), ("endings", "forms")], "topic string, category string"))


@query("quotes_located", r"SELECT doc_id AS claim_id, doc_id, nullif(strpos(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), trim(regexp_replace(lower(q), '\s+', ' ', 'g'))), 0)::INTEGER AS place FROM (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN 'no such words here' ELSE '  ' || upper(substr(text, 30, 25)) END AS q FROM documents WHERE regexp_matches(text, '^[ -~\n]*$'))")
def quotes_located(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter(F.col("text").rlike(r"^[ -~\n]*$")).select("doc_id", "text")
    claims = docs.select(F.col("doc_id").alias("claim_id"), "doc_id", F.when(F.col("doc_id") % 4 == 0, "no such words here").otherwise(F.concat(F.lit("  "), F.upper(F.substring("text", 30, 25)))).alias("quote"))
    return overview.dated_evidence(claims, docs)


@query("region_totals", RECORDS_SQL + " SELECT 'region' AS grouping, CASE WHEN country IN ('C0', 'C1', 'C2') THEN 'north' ELSE 'south' END AS name, count(*) AS docs FROM listed GROUP BY 2 UNION ALL SELECT 'coalition', c, count(DISTINCT doc_id) FROM listed JOIN (VALUES ('C1', 'A'), ('C2', 'A'), ('C2', 'B'), ('C3', 'B')) v(k, c) ON k = country GROUP BY 2")
def region_totals(spark, sf_dir):
    regions = spark.createDataFrame([(f"C{i}", "north" if i < 3 else "south") for i in range(6)], "country string, region string")
    return overview.by_region(listed(spark, sf_dir), regions, spark.createDataFrame([("C1", "A"), ("C2", "A"), ("C2", "B"), ("C3", "B")], "country string, coalition string"))


@query("found_and_stored", RECORDS_SQL + " SELECT country, count(*) AS found, count_if(status = 'stored')::BIGINT AS stored FROM docs JOIN sources USING (source) GROUP BY country")
def found_and_stored(spark, sf_dir):
    return overview.found_stored(documents(spark, sf_dir).join(sources(spark, sf_dir), "source"))


@query("console_word", "SELECT 'CUSTOMER' AS asked, p_partkey AS key, p_name AS name FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part WHERE lower(p_name) = (SELECT lower(min(p_name)) FROM part) AND p_retailprice = (SELECT max(p_retailprice) FROM part WHERE lower(p_name) = (SELECT lower(min(p_name)) FROM part)))")
def console_word(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    asked = part.agg(F.min("p_name")).first()[0]
    rows = part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), "p_retailprice")
    return overview.resolve_console(rows, asked, F.col("p_retailprice")).select(F.lit("CUSTOMER").alias("asked"), "key", "name")


@query("actor_agency_partners", RECORDS_SQL + " SELECT l.source, p.a, p.b, count(DISTINCT p.doc_id) AS docs FROM pairs p JOIN listed l USING (doc_id) JOIN actors x ON x.actor = p.a JOIN actors y ON y.actor = p.b WHERE (x.since IS NULL OR l.year IS NULL OR l.year >= x.since) AND (y.since IS NULL OR l.year IS NULL OR l.year >= y.since) GROUP BY ALL")
def actor_agency_partners(spark, sf_dir):
    near = records.actor_pairs(records.mentions(spark, sf_dir))
    rows = scope.pairs_after_founding(near, listed(spark, sf_dir).select("doc_id", "source", "year"), records.actors(spark))
    return rows.groupBy("source", "a", "b").agg(F.count_distinct("doc_id").alias("docs"))


@query("agency_reports", RECORDS_SQL + " SELECT l.source, min(year) AS first, max(year) AS last, count(*) AS docs, count(DISTINCT a.actor) AS actors FROM listed l LEFT JOIN doc_actors a USING (doc_id) GROUP BY l.source")
def agency_reports(spark, sf_dir):
    joined = listed(spark, sf_dir).select("doc_id", "source", "year").join(_named(spark, sf_dir), "doc_id", "left")
    return joined.groupBy("source").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.count("*").alias("docs"), F.count_distinct("actor").alias("actors"))


def _named(spark, sf_dir):
    return records.doc_actors(records.mentions(spark, sf_dir)).select("doc_id", "actor")


