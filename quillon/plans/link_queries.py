"""Queries over citations, codes and techniques."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import links, scope
from quillon.plans.registry import query
from quillon.sources import records
from quillon.sources.library import documents, listed, read, sources
from quillon.sources.records import RECORDS_SQL

# Texts with addresses: each page cites another page, a site of a source, an outside host and, every third, itself.
HOMES = [("example.org", "s1"), ("example.com/fr", "s2"), ("example.com", "s3"), ("press.example.net", "s4"), ("example.net", "s5"), ("twin.example", "s6"), ("twin.example", "s7")]
_NORM = r"regexp_replace(lower(regexp_extract({u}, '^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\.', '')"
_ADDRESS = _NORM + r" || regexp_replace(lower(regexp_extract({u}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)), '/+$', '')"
_CITING_SQL = f"""WITH p AS (SELECT a.page_id AS doc_id, a.url, 'See ' || b.url || '. Also (http://blog.outside' || CAST(a.page_id % 7 AS VARCHAR) || '.net/x/), https://www.press.example.net/deep/' || CAST(a.page_id % 5 AS VARCHAR) || ' and http://www.twin.example/a' || CASE WHEN a.page_id % 3 = 0 THEN ' ' || a.url ELSE '' END AS text FROM pages a JOIN pages b ON b.page_id = a.page_id // 2),
u AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, 'https?://[^\\s<>"''\\])}}]+')), '[.,;:!?]+$', '') AS url FROM p),
f AS (SELECT doc_id, {_ADDRESS.format(u='url')} AS address, min({_NORM.format(u='url')}) AS host, count(*) AS n FROM u GROUP BY 1, 2),
own AS (SELECT doc_id, {_ADDRESS.format(u='url')} AS address FROM p),
homes(home, source) AS (VALUES {", ".join(f"('{h}', '{s}')" for h, s in HOMES)}),
h AS (SELECT home, min(source) AS source, count(*) AS owners FROM homes GROUP BY home),
c AS (SELECT address, unnest(range(len(parts) + greatest(len(labels) - 2, 0))) AS place, parts, labels FROM (SELECT address, string_split(address, '/') AS parts, string_split(string_split(address, '/')[1], '.') AS labels FROM (SELECT address FROM f UNION SELECT address FROM own))),
s AS (SELECT address, min({{'p': place, 's': source, 'k': owners}}) AS x FROM c JOIN h ON home = CASE WHEN place < len(parts) THEN array_to_string(parts[1:len(parts) - place], '/') ELSE array_to_string(labels[place - len(parts) + 2:], '.') END GROUP BY address),
site AS (SELECT address, x.s AS source FROM s WHERE x.k = 1),
one AS (SELECT address, min(doc_id) AS to_doc FROM own GROUP BY address HAVING count(*) = 1),
r AS (SELECT f.doc_id, f.address, f.host, f.n, to_doc, t.source AS to_source FROM f LEFT JOIN one USING (address) LEFT JOIN site t ON t.address = f.address JOIN own o ON o.doc_id = f.doc_id LEFT JOIN site m ON m.address = o.address
WHERE (m.source IS NULL OR t.source IS NULL OR m.source <> t.source) AND (to_doc IS NULL OR to_doc <> f.doc_id))"""


def _citing(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    b = p.select(F.col("page_id").alias("other"), F.col("url").alias("cited"))
    joined = p.join(b, F.floor(F.col("page_id") / 2) == F.col("other"))
    text = F.concat(F.lit("See "), "cited", F.lit(". Also (http://blog.outside"), (F.col("page_id") % 7).cast("string"), F.lit(".net/x/), https://www.press.example.net/deep/"), (F.col("page_id") % 5).cast("string"), F.lit(" and http://www.twin.example/a"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), "url")).otherwise(""))
    return joined.select(F.col("page_id").alias("doc_id"), "url", text.alias("text"))


@query("citations_resolved", _CITING_SQL + " SELECT doc_id, address, host, n, to_doc, to_source FROM r")
def citations_resolved(spark, sf_dir):
    return links.resolved(_citing(spark, sf_dir), spark.createDataFrame(HOMES, "home string, source string"))


@query("citation_sites", _CITING_SQL + " SELECT address, source FROM site")
def citation_sites(spark, sf_dir):
    docs = _citing(spark, sf_dir)
    found = links.addresses(docs).select("address").unionByName(docs.select(links.address_norm(F.col("url")).alias("address")))
    return links.site_of(found, spark.createDataFrame(HOMES, "home string, source string"))


@query("citation_flows", RECORDS_SQL + " SELECT s.publisher AS citing, t.publisher AS cited, count(*) AS links, count(DISTINCT c.doc_id) AS docs FROM citations c JOIN docs d USING (doc_id) JOIN sources s ON s.source = d.source JOIN sources t ON t.source = c.to_source WHERE d.source <> c.to_source GROUP BY ALL")
def citation_flows(spark, sf_dir):
    return links.overview(records.citations(spark, sf_dir), documents(spark, sf_dir), sources(spark, sf_dir))


@query("citation_totals", RECORDS_SQL + " SELECT CASE WHEN to_doc IS NOT NULL THEN 'document' WHEN to_source IS NOT NULL THEN 'source' ELSE 'host' END AS kind, coalesce(CAST(to_doc AS VARCHAR), to_source, host) AS target, count(*) AS links, count(DISTINCT doc_id) AS docs FROM citations GROUP BY 1, 2")
def citation_totals(spark, sf_dir):
    return links.totals(records.citations(spark, sf_dir))


@query("citations_of_documents", RECORDS_SQL + " SELECT d.doc_id, (SELECT count(DISTINCT to_doc) FROM citations c WHERE c.doc_id = d.doc_id) AS cites, (SELECT count(DISTINCT c.doc_id) FROM citations c WHERE c.to_doc = d.doc_id) AS cited_by, (SELECT count(DISTINCT to_source) FROM citations c WHERE c.doc_id = d.doc_id AND to_doc IS NULL) AS agencies, (SELECT count(DISTINCT host) FROM citations c WHERE c.doc_id = d.doc_id AND to_doc IS NULL AND to_source IS NULL) AS hosts FROM docs d")
def citations_of_documents(spark, sf_dir):
    return links.of_documents(records.citations(spark, sf_dir), documents(spark, sf_dir))


_MARKED_SQL = "t AS (SELECT doc_id, 'cve-2019-' || CAST(1000 + doc_id % 90 AS VARCHAR) || ' and CVE–1998–4444, T10' || CAST(10 + doc_id % 60 AS VARCHAR) || '.001 ' || substr(text, 1, 100) || ' CVE‑2021‑' || CAST(20000 + doc_id % 30 AS VARCHAR) || ' T1059 T1059' AS text FROM documents)"


def _marked(spark, sf_dir):
    i = F.col("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("cve-2019-"), (1000 + i % 90).cast("string"), F.lit(" and CVE–1998–4444, T10"), (10 + i % 60).cast("string"), F.lit(".001 "), F.substring("text", 1, 100), F.lit(" CVE‑2021‑"), (20000 + i % 30).cast("string"), F.lit(" T1059 T1059")).alias("text"))


@query("code_marks", f"WITH {_MARKED_SQL}, m AS (SELECT doc_id, upper(regexp_replace(unnest(regexp_extract_all(text, '(?i)CVE[-‐‑‒–—][0-9]{{4}}[-‐‑‒–—][0-9]{{4,7}}')), '[‐‑‒–—]', '-', 'g')) AS code, text FROM t) SELECT doc_id, code, count(*) AS n, (CASE WHEN code LIKE 'CVE-2019-%' THEN 0 ELSE strpos(text, 'CVE‑2021‑') - 1 END)::INTEGER AS first FROM m WHERE CAST(substr(code, 5, 4) AS INTEGER) BETWEEN 1999 AND 2025 GROUP BY doc_id, code, text")
def code_marks(spark, sf_dir):
    return links.code_marks(_marked(spark, sf_dir), 2025).drop("places")


@query("technique_marks", f"WITH {_MARKED_SQL}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\bT1[0-9]{{3}}(?:\\.[0-9]{{3}})?\\b')) AS technique FROM t) SELECT doc_id, technique, count(*) AS n, technique IN ('T1059', 'T1020.001', 'T1033.001') AS known FROM m GROUP BY doc_id, technique")
def technique_marks(spark, sf_dir):
    return links.technique_marks(_marked(spark, sf_dir), spark.createDataFrame([("T1059",), ("T1020.001",), ("T1033.001",)], "technique string"))


@query("code_table", RECORDS_SQL + " SELECT code, count(DISTINCT doc_id) AS docs, count(DISTINCT source) AS agencies, count(DISTINCT country) AS countries, min(year) AS first, max(year) AS last, bool_or(known_year IS NOT NULL) AS known FROM codes JOIN listed USING (doc_id) GROUP BY code")
def code_table(spark, sf_dir):
    return links.code_overview(records.codes(spark, sf_dir), listed(spark, sf_dir).select("doc_id", "source", "country", "year"))


@query("code_buckets", RECORDS_SQL + ", r AS (SELECT * FROM codes JOIN listed USING (doc_id) WHERE year IS NOT NULL) SELECT 'age' AS measure, CAST(least(10, greatest(-1, year - code_year)) AS VARCHAR) AS bucket, count(*) AS pairs, count(DISTINCT doc_id) AS docs FROM r GROUP BY 1, 2 UNION ALL SELECT 'listing', CASE WHEN year < known_year THEN 'before' WHEN year = known_year THEN 'same' ELSE 'after' END, count(*), count(DISTINCT doc_id) FROM r WHERE known_year IS NOT NULL GROUP BY 1, 2")
def code_buckets(spark, sf_dir):
    return links.code_lags(records.codes(spark, sf_dir), listed(spark, sf_dir).select("doc_id", "year"))


@query("actor_codes", RECORDS_SQL + " SELECT actor, code, count(DISTINCT c.doc_id) AS docs FROM codes c JOIN mentions m ON m.doc_id = c.doc_id AND abs(m.start - c.start) <= 600 WHERE c.doc_id IN (SELECT doc_id FROM listed) GROUP BY actor, code")
def actor_codes(spark, sf_dir):
    return links.actor_codes(scope.near_marks(records.codes(spark, sf_dir), records.mentions(spark, sf_dir)), listed(spark, sf_dir))


@query("tactic_grid", RECORDS_SQL + ", r AS (SELECT * FROM techniques JOIN listed USING (doc_id) WHERE tactic IS NOT NULL), p AS (SELECT tactic, technique, count(DISTINCT doc_id) AS docs FROM r GROUP BY ALL), w AS (SELECT tactic, count(DISTINCT doc_id) AS tactic_docs FROM r GROUP BY ALL) SELECT tactic, technique, docs, rank, tactic_docs FROM (SELECT *, row_number() OVER (PARTITION BY tactic ORDER BY docs DESC, technique)::INTEGER AS rank FROM p) JOIN w USING (tactic) WHERE rank <= 12")
def tactic_grid(spark, sf_dir):
    return links.tactic_grid(records.techniques(spark, sf_dir), listed(spark, sf_dir))


@query("codes_of_documents", RECORDS_SQL + " SELECT d.doc_id, coalesce((SELECT string_agg(DISTINCT code, ',' ORDER BY code) FROM codes c WHERE c.doc_id = d.doc_id), '') AS codes, coalesce((SELECT string_agg(DISTINCT technique, ',' ORDER BY technique) FROM techniques t WHERE t.doc_id = d.doc_id), '') AS techniques FROM docs d")
def codes_of_documents(spark, sf_dir):
    per = lambda df, c, name: df.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set(c)), ",").alias(name))
    docs = documents(spark, sf_dir).select("doc_id")
    return docs.join(per(records.codes(spark, sf_dir), "code", "codes"), "doc_id", "left").join(per(records.techniques(spark, sf_dir), "technique", "techniques"), "doc_id", "left").na.fill("")
