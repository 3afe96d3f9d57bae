"""Queries over actors: lists, timelines, partners, connections, pairs, countries, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import actors as views
from quillon.operators import names
from quillon.plans.library_queries import TOPIC_SQL, tagged
from quillon.plans.registry import query
from quillon.sources import records
from quillon.sources.library import listed
from quillon.sources.records import RECORDS_SQL

#: named: mentions of documents in scope from the founding year on; near: pairs of a passage likewise.
_SCOPED = RECORDS_SQL + """
, named AS (SELECT d.doc_id, d.actor, d.hits, d.spans, l.source, l.country, l.year, a.kind, a.label, a.iso FROM doc_actors d JOIN listed l USING (doc_id) JOIN actors a USING (actor) WHERE since IS NULL OR year IS NULL OR year >= since
), near AS (SELECT p.doc_id, p.a, p.b, p.n, l.year, l.source FROM pairs p JOIN listed l USING (doc_id) JOIN actors x ON x.actor = p.a JOIN actors y ON y.actor = p.b WHERE (x.since IS NULL OR l.year IS NULL OR l.year >= x.since) AND (y.since IS NULL OR l.year IS NULL OR l.year >= y.since)
), both_ways AS (SELECT a AS actor, b AS other, doc_id, year FROM near UNION ALL SELECT b, a, doc_id, year FROM near)"""
_TOPICAL = TOPIC_SQL + _SCOPED[len(RECORDS_SQL.split(", actors(actor")[0]) :]


def _all(spark, sf_dir):
    return records.doc_actors(records.mentions(spark, sf_dir)), listed(spark, sf_dir).select("doc_id", "source", "country", "year"), records.actors(spark)


def _near(spark, sf_dir):
    return records.actor_pairs(records.mentions(spark, sf_dir)), listed(spark, sf_dir).select("doc_id", "source", "country", "year"), records.actors(spark)


@query("actor_list", _SCOPED + " SELECT actor, label, kind, count(DISTINCT doc_id) AS docs, count(DISTINCT source) AS agencies, count(DISTINCT country) AS countries, min(year) AS first, max(year) AS last FROM named WHERE kind <> 'country' AND contains(lower(label), 'e') GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2")
def actor_list(spark, sf_dir):
    return views.actor_list(*_all(spark, sf_dir), asked="e", least=2)


@query("actor_years", _SCOPED + ", y AS (SELECT year, count(DISTINCT doc_id) AS docs FROM named WHERE actor = 'Q1' AND year IS NOT NULL GROUP BY year), o AS (SELECT year, count(*) AS of FROM listed GROUP BY year) SELECT s.year, coalesce(docs, 0) AS docs, coalesce(o.of, 0) AS of, CASE WHEN o.of > 0 THEN round(coalesce(docs, 0) / o.of, 4) END AS share FROM (SELECT unnest(range((SELECT min(year) FROM y), (SELECT max(year) FROM y) + 1)) AS year) s LEFT JOIN y USING (year) LEFT JOIN o USING (year)")
def actor_years(spark, sf_dir):
    return views.actor_years(*_all(spark, sf_dir), "Q1")


@query("actor_agencies", _SCOPED + " SELECT source, country, count(DISTINCT doc_id) AS docs, min(year) AS first, max(year) AS last FROM named WHERE actor = 'Q6' GROUP BY ALL")
def actor_agencies(spark, sf_dir):
    return views.actor_agencies(*_all(spark, sf_dir), "Q6")


@query("actor_before", RECORDS_SQL + " SELECT doc_id, actor, year, since FROM doc_actors JOIN listed USING (doc_id) JOIN actors USING (actor) WHERE year < since")
def actor_before(spark, sf_dir):
    return views.before_founding(*_all(spark, sf_dir))


@query("actor_related", _SCOPED + ", c AS (SELECT b.actor, other, x.kind, count(DISTINCT doc_id) AS docs FROM both_ways b JOIN actors x ON x.actor = other GROUP BY ALL) SELECT actor, other, kind, docs, rank FROM (SELECT *, row_number() OVER (PARTITION BY actor, kind = 'country' ORDER BY docs DESC, other)::INTEGER AS rank FROM c) WHERE rank <= 3")
def actor_related(spark, sf_dir):
    return views.related(*_near(spark, sf_dir), k=3)


@query("actor_connections", _SCOPED + r""", l AS (SELECT a AS actor, b AS other, rel, rel AS says FROM actor_links UNION ALL SELECT b, a, rel, '< ' || rel FROM actor_links), g AS (SELECT actor, other, CASE WHEN regexp_matches(rel, '\b(opponent|rival|enemy|conflict)') THEN 'opponents' WHEN regexp_matches(rel, '\b(part of|subsidiary|owned|member)') THEN 'parts' WHEN regexp_matches(rel, '\b(split|merged|follows|predecessor|successor)') THEN 'origin' WHEN regexp_matches(rel, '\b(sponsor|support|funded|ally)') THEN 'support' WHEN regexp_matches(rel, '\b(leader|founder|commander|head)') THEN 'people' WHEN regexp_matches(rel, '\b(uses|tool|software|technique)') THEN 'tools' WHEN regexp_matches(rel, '\b(located|country|headquarters)') THEN 'places' ELSE 'other' END AS grouped, says FROM l)
SELECT actor, other, grouped, string_agg(DISTINCT says, ' / ' ORDER BY says) AS says, coalesce((SELECT count(DISTINCT doc_id) FROM named n WHERE n.actor = g.other), 0) AS docs, coalesce((SELECT count(DISTINCT doc_id) FROM both_ways b WHERE b.actor = g.actor AND b.other = g.other), 0) AS together FROM g GROUP BY actor, other, grouped""")
def actor_connections(spark, sf_dir):
    named, docs, actors = _all(spark, sf_dir)
    return views.connections(records.links(spark), named, _near(spark, sf_dir)[0], docs, actors)


@query("pair_passages", RECORDS_SQL + ", m AS (SELECT p.doc_id, p.a, p.b, p.n, min({'d': abs(x.start - y.start), 'x': x.start, 'y': y.start}) AS m FROM pairs p JOIN mentions x ON x.doc_id = p.doc_id AND x.actor = p.a JOIN mentions y ON y.doc_id = p.doc_id AND y.actor = p.b GROUP BY ALL) SELECT doc_id, a, b, n, m.x AS first, m.y AS second FROM m WHERE m.d <= 600")
def pair_passages(spark, sf_dir):
    marks = records.mentions(spark, sf_dir)
    return views.closest_spans(records.actor_pairs(marks), records.doc_actors(marks))


@query("pair_documents", _SCOPED + ", w AS (SELECT x.actor AS a, y.actor AS b, count(*) AS anywhere FROM named x JOIN named y ON x.doc_id = y.doc_id AND x.actor < y.actor GROUP BY ALL) SELECT a, b, anywhere, coalesce((SELECT count(DISTINCT doc_id) FROM near n WHERE n.a = w.a AND n.b = w.b), 0) AS passage FROM w")
def pair_documents(spark, sf_dir):
    named, docs, actors = _all(spark, sf_dir)
    return views.pair_documents(named, _near(spark, sf_dir)[0], docs, actors)


@query("actors_nearby", RECORDS_SQL + ", c AS (SELECT x.doc_id, x.actor, y.actor AS other, any_value(a.label) AS label, any_value(a.kind) AS kind, bool_or(k.a IS NOT NULL) AS linked FROM doc_actors x JOIN doc_actors y ON x.doc_id = y.doc_id AND x.actor <> y.actor JOIN mentions m ON m.doc_id = y.doc_id AND m.actor = y.actor AND abs(m.start - x.spans[1]) <= 600 JOIN actors a ON a.actor = y.actor LEFT JOIN actor_links k ON (k.a = x.actor AND k.b = y.actor) OR (k.b = x.actor AND k.a = y.actor) GROUP BY x.doc_id, x.actor, y.actor) SELECT doc_id, actor, other, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, actor ORDER BY NOT linked, kind = 'country', label)::INTEGER AS rank FROM c) WHERE rank <= 10")
def actors_nearby(spark, sf_dir):
    named, _, actors = _all(spark, sf_dir)
    return views.nearby(named, records.links(spark), actors)


@query("densest_passages", RECORDS_SQL + ", c AS (SELECT x.doc_id, x.actor, x.start, count(*) AS marks FROM mentions x JOIN mentions y ON x.doc_id = y.doc_id AND x.actor = y.actor AND y.start BETWEEN x.start AND x.start + 600 GROUP BY ALL) SELECT doc_id, actor, max({'k': marks, 's': -start}).k AS marks, -max({'k': marks, 's': -start}).s AS start FROM c GROUP BY doc_id, actor")
def densest_passages(spark, sf_dir):
    return views.densest(records.doc_actors(records.mentions(spark, sf_dir)))


@query("agencies_compared", _SCOPED + ", c AS (SELECT x.doc_id, x.actor, x.start, count(*) AS marks FROM mentions x JOIN mentions y ON x.doc_id = y.doc_id AND x.actor = y.actor AND y.start BETWEEN x.start AND x.start + 600 GROUP BY ALL), t AS (SELECT n.actor, source, n.doc_id, max(marks) AS marks FROM named n JOIN c ON c.doc_id = n.doc_id AND c.actor = n.actor GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY actor, source ORDER BY marks DESC, doc_id)::INTEGER AS rank FROM t), p AS (SELECT actor, source, count(DISTINCT doc_id) AS docs, min(year) AS first, max(year) AS last FROM named GROUP BY ALL) SELECT p.actor, p.source, docs, first, last, doc_id, marks, rank FROM p JOIN r ON r.actor = p.actor AND r.source = p.source WHERE rank <= 3")
def agencies_compared(spark, sf_dir):
    return views.compare_agencies(*_all(spark, sf_dir))


@query("actor_first_last", _SCOPED + " SELECT actor, source, count(DISTINCT doc_id) AS docs, count(DISTINCT year) AS years, min({'y': year, 'd': doc_id}).d AS first_doc, max({'y': year, 'd': doc_id}).d AS last_doc FROM named WHERE year IS NOT NULL GROUP BY ALL")
def actor_first_last(spark, sf_dir):
    return views.first_last(*_all(spark, sf_dir))


@query("actor_country_years", _SCOPED + ", p AS (SELECT country, year, count(DISTINCT doc_id) AS n FROM named WHERE actor = 'Q1' AND year IS NOT NULL GROUP BY ALL) SELECT c.country, y.year, coalesce(n, 0) AS n FROM (SELECT DISTINCT country FROM p) c CROSS JOIN (SELECT unnest(range((SELECT min(year) FROM p), (SELECT max(year) FROM p) + 1)) AS year) y LEFT JOIN p ON p.country = c.country AND p.year = y.year")
def actor_country_years(spark, sf_dir):
    return views.country_years(*_all(spark, sf_dir), "Q1")


@query("actor_partners", _SCOPED + " SELECT actor, other, min(year) AS first, max(year) AS last, count(DISTINCT doc_id) AS docs, CASE WHEN min(year) > 2020 THEN 'new' WHEN max(year) <= 2020 THEN 'gone' ELSE 'kept' END AS state FROM both_ways WHERE year IS NOT NULL GROUP BY actor, other")
def actor_partners(spark, sf_dir):
    return views.partner_states(*_near(spark, sf_dir), last=2023)


@query("geography_about", _SCOPED + ", n AS (SELECT country, count(DISTINCT doc_id) AS docs FROM named WHERE actor = 'Q5' GROUP BY country), o AS (SELECT country, count(*) AS of FROM listed GROUP BY country) SELECT country, coalesce(docs, 0) AS docs, o.of, round(coalesce(docs, 0) / o.of, 4) AS share FROM o LEFT JOIN n USING (country) WHERE country <> 'C2'")
def geography_about(spark, sf_dir):
    return views.about_country(*_all(spark, sf_dir), "Q5")


@query("geography_from", _SCOPED + " SELECT actor, iso, count(DISTINCT doc_id) AS docs, (SELECT count(*) FROM listed WHERE country = 'C2') AS of, round(count(DISTINCT doc_id) / (SELECT count(*) FROM listed WHERE country = 'C2'), 4) AS share FROM named WHERE kind = 'country' AND country = 'C2' AND iso <> 'C2' GROUP BY actor, iso")
def geography_from(spark, sf_dir):
    return views.from_country(*_all(spark, sf_dir), "C2")


@query("topic_actors", _TOPICAL + ", o AS (SELECT actor, count(DISTINCT doc_id) AS of FROM named WHERE kind <> 'country' GROUP BY actor), p AS (SELECT topic, actor, count(DISTINCT doc_id) AS n FROM tagged t JOIN named USING (doc_id) WHERE rank <= 3 AND kind <> 'country' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3), s AS (SELECT topic, actor, n, o.of, round(n * n / o.of, 6) AS score FROM p JOIN o USING (actor)) SELECT topic, actor, n, of, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, actor)::INTEGER AS rank FROM s) WHERE rank <= 6")
def topic_actors(spark, sf_dir):
    return views.topic_actors(tagged(spark, sf_dir), *_all(spark, sf_dir))


_CLUSTERS = [("c1", "Q1"), ("c1", "Q2"), ("c1", "Q6"), ("c2", "Q3"), ("c2", "Q7"), ("c2", "Q9"), ("c2", "Q11")]


@query("cluster_summary", _TOPICAL + """, m(cluster, actor) AS (VALUES ('c1', 'Q1'), ('c1', 'Q2'), ('c1', 'Q6'), ('c2', 'Q3'), ('c2', 'Q7'), ('c2', 'Q9'), ('c2', 'Q11')), i AS (SELECT DISTINCT x.cluster, n.doc_id, n.year, n.source FROM near n JOIN m x ON x.actor = n.a JOIN m y ON y.actor = n.b AND y.cluster = x.cluster), t AS (SELECT cluster, topic, count(*) AS n FROM i JOIN tagged USING (doc_id) WHERE rank <= 3 GROUP BY ALL HAVING count(*) >= 2)
SELECT cluster, (SELECT count(*) FROM m WHERE m.cluster = i.cluster) AS actors, count(*) AS docs, count(DISTINCT source) AS agencies, min(year) AS first, max(year) AS last, coalesce((SELECT string_agg(topic, ',' ORDER BY n DESC, topic) FROM t WHERE t.cluster = i.cluster), '') AS topics FROM i GROUP BY cluster""")
def cluster_summary(spark, sf_dir):
    members = spark.createDataFrame(_CLUSTERS, "cluster string, actor string")
    return views.cluster_summary(members, *_near(spark, sf_dir), tagged(spark, sf_dir))


@query("actor_records", _SCOPED + " SELECT actor, CAST(year AS VARCHAR) || '-00-00' AS date, 'report' AS what, CAST(doc_id AS VARCHAR) AS note FROM named WHERE year IS NOT NULL UNION ALL SELECT a, CASE WHEN rel = 'ally of' THEN '1999-99-99' ELSE CAST(start AS VARCHAR) || '-07-00' END, 'link', rel FROM actor_links WHERE rel = 'ally of' OR start IS NOT NULL")
def actor_records(spark, sf_dir):
    named, docs, actors = _all(spark, sf_dir)
    reports = views.named_docs(named, docs, actors).filter("year is not null").select("actor", F.col("year").cast("string").alias("date"), F.col("doc_id").cast("string").alias("note"))
    stated = records.links(spark).select(F.col("a").alias("actor"), F.when(F.col("rel") == "ally of", "<1999").otherwise(F.concat(F.col("start").cast("string"), F.lit("-07"))).alias("date"), F.col("rel").alias("note")).filter("date is not null")
    return views.dated_records({"report": reports, "link": stated})


@query("actor_name_counts", _SCOPED + " SELECT kind, count(DISTINCT actor) AS actors, sum(hits)::BIGINT AS hits, count(DISTINCT doc_id) AS docs FROM named GROUP BY kind")
def actor_name_counts(spark, sf_dir):
    rows = views.named_docs(*_all(spark, sf_dir)).join(records.actors(spark).select("actor", "kind"), "actor")
    return rows.groupBy("kind").agg(F.count_distinct("actor").alias("actors"), F.sum("hits").alias("hits"), F.count_distinct("doc_id").alias("docs"))


@query("actor_pairs", RECORDS_SQL + " SELECT doc_id, a, b, n FROM pairs")
def actor_pairs(spark, sf_dir):
    return names.pairs(records.mentions(spark, sf_dir))
