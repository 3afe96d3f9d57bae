"""Queries over the library: scope, facets, text, topics, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scalar
from quillon.operators import facets, relational, statistics, text, works
from quillon.plans.registry import query
from quillon.sources import files
from quillon.sources.shared import keep
from quillon.sources.library import LIBRARY_SQL, documents, listed, read, sources, tokens

# Taxonomy and function words for the tables' invented prose: topic -> terms; language -> words.
TERMS = [("articles", "the"), ("articles", "der"), ("articles", "les"), ("articles", "los"), ("articles", "of the"), ("endings", "tion*"), ("endings", "ung*"), ("endings", "ment*"), ("endings", "ing*"), ("links", "and"), ("links", "und"), ("links", "et"), ("links", "que"), ("links", "with")]
FUNCTION_WORDS = [("the", "en"), ("of", "en"), ("and", "en"), ("der", "de"), ("die", "de"), ("und", "de"), ("la", "fr"), ("le", "fr"), ("des", "fr"), ("que", "fr"), ("la", "es"), ("el", "es"), ("que", "es"), ("los", "es")]


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "topic string, term string")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.classify(listed(spark, sf_dir), terms(spark))


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


TOPIC_SQL = LIBRARY_SQL + f"""
, terms(topic, term) AS (VALUES {_values(TERMS)}
), counts AS (
  SELECT doc_id, token, count(*) AS n FROM tokens WHERE doc_id IN (SELECT doc_id FROM listed) GROUP BY ALL
), single AS (
  SELECT doc_id, topic, term, n, row_number() OVER (PARTITION BY doc_id, topic, token ORDER BY len, term) AS r FROM (
    SELECT doc_id, topic, term, token, n, 0 AS len FROM counts JOIN terms ON token = term
    UNION ALL
    SELECT doc_id, topic, term, token, n, length(term) - 1 FROM counts JOIN terms ON term LIKE '%*' AND starts_with(token, rtrim(term, '*')))
), phrases AS (
  SELECT l.doc_id, t.topic, t.term, len(list_filter(range(1, len(words)), lambda i: words[i] = split_part(term, ' ', 1) AND words[i + 1] = split_part(term, ' ', 2))) AS hits
  FROM token_lists l JOIN listed USING (doc_id), terms t WHERE t.term LIKE '% %'
), hits AS (
  SELECT doc_id, topic, term, CAST(sum(n) AS BIGINT) AS hits FROM single WHERE r = 1 GROUP BY ALL
  UNION ALL SELECT doc_id, topic, term, hits FROM phrases WHERE hits > 0
), per AS (
  SELECT doc_id, topic, CAST(sum(hits) AS BIGINT) AS hits, count(*) AS distinct_terms, string_agg(term, ',' ORDER BY hits DESC, term) AS terms, any_value(len(words)) AS words
  FROM hits JOIN token_lists USING (doc_id) GROUP BY doc_id, topic
), scored AS (
  SELECT *, round(ln(1 + hits / words * 10000) * 10 + least(distinct_terms, 12) * 1.5, 2) AS score FROM per
  WHERE distinct_terms >= 2 AND hits >= greatest(3, ceil(words / 15000))
), tagged AS (
  SELECT doc_id, topic, hits, distinct_terms, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS rank, terms FROM scored
)"""


@query("scope_listed", LIBRARY_SQL + " SELECT doc_id, source, country, publisher, lang, year, doc_type FROM listed")
def scope_listed(spark, sf_dir):
    return listed(spark, sf_dir).select("doc_id", "source", "country", "publisher", "lang", "year", "doc_type")


@query("facet_years_language", LIBRARY_SQL + " SELECT doc_id, year FROM listed WHERE lang = 'en' AND year BETWEEN 2005 AND 2015")
def facet_years_language(spark, sf_dir):
    return facets.apply(listed(spark, sf_dir), facets.parse_console("lang:en year:2005..2015")[0]).select("doc_id", "year")


@query("facet_coalition_days", LIBRARY_SQL + " SELECT doc_id, country, CAST(added AS VARCHAR) AS added FROM listed WHERE country IN ('C1', 'C2') AND added BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def facet_coalition_days(spark, sf_dir):
    f = facets.Filters(coalition=("C1", "C2"), added_from="2024-01-05", added_to="2024-01-20")
    return facets.apply(listed(spark, sf_dir), f).select("doc_id", "country", F.col("added").cast("string").alias("added"))


@query("facet_undated_words", LIBRARY_SQL + " SELECT doc_id FROM listed WHERE year IS NULL AND doc_id IN (SELECT doc_id FROM tokens WHERE token = 'the') AND doc_id IN (SELECT doc_id FROM tokens WHERE starts_with(token, 'tion'))")
def facet_undated_words(spark, sf_dir):
    f = facets.parse_console("year:none the tion*")[0]
    return facets.apply(listed(spark, sf_dir), f, tokens=tokens(documents(spark, sf_dir))).select("doc_id")


@query("facet_topics", TOPIC_SQL + " SELECT doc_id FROM listed WHERE doc_id IN (SELECT doc_id FROM tagged WHERE topic = 'articles' AND rank <= 3) AND doc_id IN (SELECT doc_id FROM tagged WHERE topic = 'endings' AND rank <= 3)")
def facet_topics(spark, sf_dir):
    f = facets.Filters(topics=("articles", "endings"), main_topic=True)
    return facets.apply(listed(spark, sf_dir), f, topics=tagged(spark, sf_dir)).select("doc_id")


@query("facet_page", LIBRARY_SQL + " SELECT doc_id, year FROM listed ORDER BY year DESC NULLS LAST, doc_id LIMIT 50 OFFSET 50")
def facet_page(spark, sf_dir):
    return facets.page(listed(spark, sf_dir), [F.col("year").desc_nulls_last(), F.col("doc_id")], 2).select("doc_id", "year")


@query("list_counts", LIBRARY_SQL + " SELECT doc_type, lang, count(*) AS n FROM listed GROUP BY ALL")
def list_counts(spark, sf_dir):
    return listed(spark, sf_dir).groupBy("doc_type", "lang").agg(F.count("*").alias("n"))


@query("exclusions", LIBRARY_SQL + " SELECT count(*) AS docs, count_if(year IS NULL)::BIGINT AS undated, count_if(year < 2000)::BIGINT AS early, count_if(doc_type = 'notice')::BIGINT AS not_reports, count_if(publisher = 'think_tank')::BIGINT AS think_tanks, count_if(publisher = 'commercial')::BIGINT AS commercial FROM docs JOIN sources USING (source)")
def exclusions(spark, sf_dir):
    return statistics.excluded(documents(spark, sf_dir).join(sources(spark, sf_dir), "source"))


@query("text_index", LIBRARY_SQL + " SELECT token, count(DISTINCT doc_id) AS df, count(*) AS n, min(pos)::BIGINT AS first FROM tokens GROUP BY token")
def text_index(spark, sf_dir):
    return tokens(documents(spark, sf_dir)).groupBy("token").agg(F.count_distinct("doc_id").alias("df"), F.count("*").alias("n"), F.min("pos").cast("long").alias("first"))


@query("text_search", LIBRARY_SQL + " SELECT doc_id FROM tokens GROUP BY doc_id HAVING bool_or(token = 'with') AND bool_or(starts_with(token, 'ver'))")
def text_search(spark, sf_dir):
    return text.search(tokens(documents(spark, sf_dir)), ["with", "ver*"])


@query("text_phrase", LIBRARY_SQL + " SELECT a.doc_id, count(*) AS n FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the' GROUP BY a.doc_id")
def text_phrase(spark, sf_dir):
    return text.phrase(documents(spark, sf_dir), ["of", "the"])


@query("text_bm25", LIBRARY_SQL + """, c AS (SELECT doc_id, token, count(*) AS n FROM tokens GROUP BY ALL), l AS (SELECT doc_id, sum(n) AS len FROM c GROUP BY doc_id),
  g AS (SELECT count(*) AS corpus, avg(len) AS a FROM l), d AS (SELECT token, count(*) AS df FROM c GROUP BY token)
SELECT doc_id, round(sum(ln(1 + (corpus - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (n * 2.2::DOUBLE / (n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a)))), 6) AS score
FROM (SELECT doc_id, token, n::DOUBLE AS n FROM c) JOIN d USING (token) JOIN l USING (doc_id), g WHERE token IN ('verbe', 'with', 'the') GROUP BY doc_id""")
def text_bm25(spark, sf_dir):
    return text.bm25(documents(spark, sf_dir), ["verbe", "with", "the"])


@query("text_snippet", r"SELECT doc_id, CASE WHEN place > 0 THEN trim(regexp_replace(substring(text, greatest(place - 40, 1), least(40, place - 1) + 5 + 40), '\s+', ' ', 'g'), ' ') END AS snippet FROM (SELECT doc_id, text, strpos(lower(text), 'tion ') AS place FROM documents)")
def text_snippet(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), "tion ").alias("snippet"))


@query("topic_hits", TOPIC_SQL + " SELECT doc_id, topic, term, hits FROM hits")
def topic_hits(spark, sf_dir):
    return text.topic_hits(listed(spark, sf_dir), terms(spark))


@query("topic_classification", TOPIC_SQL + " SELECT doc_id, topic, hits, distinct_terms, score, rank::INTEGER AS rank, terms FROM tagged")
def topic_classification(spark, sf_dir):
    return tagged(spark, sf_dir)


@query("topic_trend", TOPIC_SQL + """, t AS (SELECT year, count(*) AS total, count(DISTINCT source) AS s FROM listed GROUP BY year), o AS (SELECT year, count(*) AS docs, count(DISTINCT source) AS sources FROM listed WHERE doc_id IN (SELECT doc_id FROM tagged WHERE topic = 'links') GROUP BY year)
SELECT y.year, coalesce(docs, 0) AS docs, coalesce(total, 0) AS total, CASE WHEN total > 0 THEN round(coalesce(docs, 0) / total, 4) ELSE 0 END AS share, coalesce(sources, 0) AS sources, CASE WHEN s > 0 THEN round(coalesce(sources, 0) / s, 4) ELSE 0 END AS source_share
FROM (SELECT unnest(range(2000, 2026)) AS year) y LEFT JOIN t USING (year) LEFT JOIN o USING (year)""")
def topic_trend(spark, sf_dir):
    return statistics.topic_trend(listed(spark, sf_dir), tagged(spark, sf_dir), "links", 2000, 2025)


@query("topic_rising", TOPIC_SQL + """, p AS (SELECT doc_id, CASE WHEN year BETWEEN 2018 AND 2019 THEN 'r' WHEN year BETWEEN 2015 AND 2017 THEN 'b' END AS p FROM listed), t AS (SELECT count_if(p = 'r') AS tr, count_if(p = 'b') AS tb FROM p)
SELECT topic, recent, before, round(100 * (CASE WHEN tr > 0 THEN recent / tr ELSE 0 END - CASE WHEN tb > 0 THEN before / tb ELSE 0 END), 1) AS points FROM (SELECT topic, count_if(p = 'r')::BIGINT AS recent, count_if(p = 'b')::BIGINT AS before FROM p JOIN tagged USING (doc_id) WHERE p IS NOT NULL GROUP BY topic), t""")
def topic_rising(spark, sf_dir):
    return statistics.rising(listed(spark, sf_dir), tagged(spark, sf_dir), 2020)


@query("emphasis_matrix", TOPIC_SQL + """, r AS (SELECT country, count(*) AS n_rows FROM listed GROUP BY country HAVING count(*) >= 5), o AS (SELECT topic, count(*) AS all_n FROM tagged GROUP BY topic), c AS (SELECT country, topic, count(*) AS n FROM listed JOIN tagged USING (doc_id) GROUP BY ALL)
SELECT country, topic, n, round(n / n_rows, 4) AS share, round((n / n_rows) / (all_n / (SELECT count(*) FROM listed)), 4) AS lift FROM c JOIN r USING (country) JOIN o USING (topic)""")
def emphasis_matrix(spark, sf_dir):
    return statistics.emphasis(listed(spark, sf_dir), tagged(spark, sf_dir), "country")


@query("briefing", TOPIC_SQL + """, i AS (SELECT doc_id FROM listed WHERE country = 'C2'), o AS (SELECT topic, count(*) AS n FROM tagged JOIN i USING (doc_id) GROUP BY topic), w AS (SELECT topic, count(*) AS n_all FROM tagged GROUP BY topic),
x AS (SELECT topic, n, (n / (SELECT count(*) FROM i)) / (n_all / (SELECT count(*) FROM listed)) AS l FROM o JOIN w USING (topic)) SELECT topic, n, round(l, 4) AS lift, round(n * log2(l), 4) AS weight FROM x WHERE l > 1 AND n >= 3""")
def briefing(spark, sf_dir):
    return statistics.briefing(listed(spark, sf_dir), tagged(spark, sf_dir), F.col("country") == "C2")


@query("update_jumps", TOPIC_SQL + """, s AS (SELECT doc_id, added = DATE '2024-01-03' AS fresh FROM listed WHERE added <= DATE '2024-01-03'), t AS (SELECT count_if(fresh) AS tn, count_if(NOT fresh) AS tb FROM s),
p AS (SELECT topic, count_if(fresh)::BIGINT AS new, count_if(NOT fresh)::BIGINT AS before FROM s JOIN tagged USING (doc_id) GROUP BY topic)
SELECT topic, new, before, round(100 * (new / tn - before / tb), 1) AS jump FROM p, t WHERE new >= 3 AND new / tn > before / tb""")
def update_jumps(spark, sf_dir):
    return statistics.update_jumps(listed(spark, sf_dir), tagged(spark, sf_dir), "2024-01-03")


@query("watchlist", LIBRARY_SQL + " SELECT 'english' AS query, CAST(added AS VARCHAR) AS added, count(*) AS n FROM listed WHERE lang = 'en' GROUP BY listed.added UNION ALL SELECT 'recent', CAST(added AS VARCHAR), count(*) FROM listed WHERE year >= 2015 GROUP BY listed.added")
def watchlist(spark, sf_dir):
    return statistics.watch_counts(listed(spark, sf_dir), {"english": F.col("lang") == "en", "recent": F.col("year") >= 2015}).withColumn("added", F.col("added").cast("string"))


@query("coverage_grid", LIBRARY_SQL + """, g AS (SELECT country, publisher, bool_or(active) AS open FROM sources GROUP BY ALL), p AS (SELECT country, publisher, count(*) AS docs, max(year) AS last FROM listed GROUP BY ALL)
SELECT country, publisher, coalesce(docs, 0) AS docs, last, CASE WHEN NOT open THEN 'closed' WHEN docs IS NULL THEN 'empty' WHEN last < 2021 THEN 'stale' ELSE 'covered' END AS state FROM g LEFT JOIN p USING (country, publisher)""")
def coverage_grid(spark, sf_dir):
    return statistics.coverage(listed(spark, sf_dir), sources(spark, sf_dir), 2024)


_FW = f"fw(token, guess) AS (VALUES {_values(FUNCTION_WORDS)}), wt AS (SELECT token, guess, 1 / count(*) OVER (PARTITION BY token) AS w FROM fw), ls AS (SELECT doc_id, guess, round(sum(w) / any_value(len(words)), 8) AS share FROM tokens JOIN wt USING (token) JOIN token_lists USING (doc_id) GROUP BY doc_id, guess)"


@query("language_guess", LIBRARY_SQL + f", {_FW}, r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(share) OVER w, 0) AS nx FROM ls WINDOW w AS (PARTITION BY doc_id ORDER BY share DESC, guess)) SELECT doc_id, guess, share FROM r WHERE r = 1 AND share >= 0.03 AND share >= 2 * nx")
def language_guess(spark, sf_dir):
    words = spark.createDataFrame(FUNCTION_WORDS, "token string, guess string")
    return text.identify(text.language_scores(documents(spark, sf_dir), words))


@query("distinctive_terms", LIBRARY_SQL + r""", c AS (SELECT doc_id, token, count(*) AS n FROM tokens GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM c GROUP BY token),
s AS (SELECT doc_id, token, n, round(n * ln((SELECT count(*) + 1 FROM documents) / (df + 1)), 6) AS score FROM c JOIN d USING (token) WHERE length(token) >= 3 AND n >= 3 AND token NOT IN (""" + ", ".join(f"'{w}'" for w in text.STOP) + r""") AND NOT regexp_matches(token, '^[0-9]+$'))
SELECT doc_id, token, n, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, token)::INTEGER AS rank FROM s) WHERE rank <= 12""")
def distinctive_terms(spark, sf_dir):
    return text.distinctive_terms(documents(spark, sf_dir))


def _said(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    said = turns.select("conv_id", "turn", F.posexplode(scalar.sentences(F.col("text"))).alias("p", "sentence"))
    return said.withColumn("place", F.row_number().over(relational.Window.partitionBy("conv_id").orderBy("turn", "p"))).withColumnRenamed("conv_id", "unit")


@query("key_sentences")
def key_sentences(spark, sf_dir):
    return text.key_sentences(_said(spark, sf_dir))


@query("titled_topics", TOPIC_SQL.split(", tagged AS (")[0] + """, title AS (SELECT doc_id, 'with ' || source AS title FROM listed), th AS (SELECT DISTINCT doc_id, 'links' AS topic FROM title),
s2 AS (SELECT p.doc_id, p.topic, hits, distinct_terms, t.doc_id IS NOT NULL AS titled, words FROM per p LEFT JOIN th t ON t.doc_id = p.doc_id AND t.topic = p.topic)
SELECT doc_id, topic, hits, distinct_terms, round(ln(1 + hits / words * 10000) * 10 + least(distinct_terms, 12) * 1.5 + CASE WHEN titled THEN 25 ELSE 0 END, 2) AS score FROM s2 WHERE titled OR (distinct_terms >= 2 AND hits >= greatest(3, ceil(words / 15000)))""")
def titled_topics(spark, sf_dir):
    docs = listed(spark, sf_dir).withColumn("title", F.concat(F.lit("with "), "source"))
    return text.classify(docs, terms(spark)).select("doc_id", "topic", "hits", "distinct_terms", "score")


@query("page_addresses", r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\.', '') AS host,
regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\.', '') || regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)), '/+$', '') AS address,
array_to_string(list_slice(string_split(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\.', ''), '.'), -2, -1), '.') AS family FROM pages""")
def page_addresses(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", scalar.host(url).alias("host"), scalar.address_norm(url).alias("address"), scalar.domain_family(url).alias("family"))


@query("page_headings", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS heading FROM pages")
def page_headings(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", files.heading(F.col("html")).alias("heading"))


@query("page_visible_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<noscript\b.*?</noscript\s*>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS text_md5 FROM pages")
def page_visible_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(files.visible_text(F.col("html"))).alias("text_md5"))


_A = r"""'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'"""
_LINKS_SQL = rf"""WITH l AS (SELECT page_id, url AS page, unnest(regexp_extract_all(html, {_A}, 1)) AS href, unnest(regexp_extract_all(html, {_A}, 2)) AS t, unnest(range(len(regexp_extract_all(html, {_A}, 1)))) AS place FROM pages),
links AS (SELECT page_id, page, place::INTEGER AS place, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href ELSE regexp_extract(page, '^([a-z]+://[^/]+)', 1) || href END AS url, t AS title FROM l),
hosts AS (SELECT page_id, regexp_replace(lower(regexp_extract(page, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www\.', '') AS citing, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www\.', '') AS cited FROM links)"""


@query("page_links", _LINKS_SQL + " SELECT page_id, place, url, title FROM links")
def page_links(spark, sf_dir):
    return files.page_links(read(spark, sf_dir, "pages"))


@query("citation_hosts", _LINKS_SQL + " SELECT citing, cited, count(*) AS links, count(DISTINCT page_id) AS pages FROM hosts GROUP BY citing, cited")
def citation_hosts(spark, sf_dir):
    found = files.page_links(read(spark, sf_dir, "pages")).select("page_id", scalar.host(F.col("url")).alias("cited")).filter("cited <> ''")
    own = read(spark, sf_dir, "pages").select("page_id", scalar.host(F.col("url")).alias("citing"))
    return found.join(own, "page_id").groupBy("citing", "cited").agg(F.count("*").alias("links"), F.count_distinct("page_id").alias("pages"))


@query("exact_duplicates", "SELECT doc_id AS id, sha256(text) AS sha256, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY text) THEN 'stored' ELSE 'duplicate' END AS status FROM documents")
def exact_duplicates(spark, sf_dir):
    return files.exact_duplicates(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query("works", "SELECT d.doc_id AS id, w.work_id FROM documents d JOIN (SELECT text, arg_max(doc_id, {'w': n_chars * CASE WHEN lang = 'en' THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END, 'i': -doc_id}) AS work_id FROM documents GROUP BY text) w ON d.text = w.text")
def grouped_works(spark, sf_dir):
    held = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"), "lang", F.col("n_chars").alias("chars"))
    return works.group_works(held, [["digest"]], checkpoint=lambda df: keep(df, "works"))


_TITLES = "files AS (SELECT source, lang, 'Annual Report ' || lang || ' ' || CAST(2000 + doc_id % 25 AS VARCHAR) AS title, CAST(2000 + doc_id % 25 AS BIGINT) AS year FROM documents)"


@query("series_editions", f"""WITH {_TITLES}, s AS (SELECT source AS series, min(year) AS since, list(DISTINCT lang) AS langs FROM files GROUP BY source), c AS (SELECT series, unnest(range(since, 2025)) AS year, langs FROM s), x AS (SELECT series, year, unnest(langs) AS lang FROM c), h AS (SELECT DISTINCT source AS series, year, lang FROM files)
SELECT x.series, x.year, x.lang, CASE WHEN h.series IS NOT NULL THEN 'have' WHEN x.year >= 2024 THEN 'expected' ELSE 'missing' END AS state FROM x LEFT JOIN h ON x.series = h.series AND x.year = h.year AND x.lang = h.lang""")
def series_editions(spark, sf_dir):
    held = read(spark, sf_dir, "documents").select(F.col("source").alias("series"), (2000 + F.col("doc_id") % 25).alias("year"), "lang", F.lit(True).alias("stored"))
    known = held.groupBy("series").agg(F.min("year").alias("since"), F.collect_set("lang").alias("langs"))
    return works.editions(known, held, 2024)


@query("series_proposals", """WITH f AS (SELECT DISTINCT source, lang, lang AS key, 2000 + doc_id % 25 AS year FROM documents), y AS (SELECT source, lang, key, list(year ORDER BY year) AS years FROM f GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT a.source, a.lang, a.key, any_value(a.years) AS years, min({'n': -len(b.years), 'l': b.lang, 'k': b.key}) AS t FROM y a JOIN y b ON a.source = b.source AND len(list_intersect(a.years, b.years)) / len(list_distinct(list_concat(a.years, b.years))) >= 0.5 AND (-len(b.years), b.lang, b.key) <= (-len(a.years), a.lang, a.key) GROUP BY a.source, a.lang, a.key),
m AS (SELECT source, t.k AS key, t.l AS first, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, list_distinct(flatten(list(years))) AS years FROM c GROUP BY source, t.k, t.l) SELECT source, key, langs, list_min(years) AS since, list_max(years) AS until, len(years)::INTEGER AS years FROM m""")
def series_proposals(spark, sf_dir):
    held = read(spark, sf_dir, "documents").select("source", "lang", (2000 + F.col("doc_id") % 25).alias("year"), F.concat(F.lit("Annual Report "), "lang", F.lit(" "), (2000 + F.col("doc_id") % 25).cast("string")).alias("title"))
    return works.propose_series(held)


@query("label_precision", "SELECT lang, count(*) AS n, sum(quality)::BIGINT AS right, round(avg(quality), 4) AS precision FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def label_precision(spark, sf_dir):
    both = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("right"), F.round(F.avg("quality"), 4).alias("precision"))


@query("review_order", "SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 2654435761 + length(lang)) % 1000003, doc_id)::INTEGER AS rank FROM documents) WHERE rank <= 5")
def review_order(spark, sf_dir):
    order = relational.shuffled_order(F.col("doc_id"), F.length("lang"))
    return relational.top_k(read(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], [order, F.col("doc_id")], 5).select("lang", "doc_id", "rank")


@query("script_shares", r"SELECT doc_id, CASE WHEN l > 0 THEN round(length(regexp_replace(text, '[^a-zA-Z]+', '', 'g')) / l, 6) ELSE 0 END AS ascii FROM (SELECT doc_id, text, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS l FROM documents)")
def script_shares(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", scalar.script_share(F.col("text"), "a-zA-Z").alias("ascii"))


@query("sentence_counts", r"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10) || '+'), lambda s: length(trim(s, ' ')) > 0))::INTEGER AS n FROM documents")
def sentence_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(scalar.sentences(F.col("text"))).alias("n"))
