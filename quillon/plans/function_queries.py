"""Queries over scalar rules, on texts that both sides make of the documents alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import rules, scalar
from quillon.plans.registry import query
from quillon.sources.library import TOKEN_GAP, read

_I = "doc_id"


def _pick(rows: list[str], i=None):
    i = F.col(_I) if i is None else i
    return F.element_at(F.array(*[F.lit(r) for r in rows]), (i % len(rows) + 1).cast("int"))


def _pick_sql(rows: list[str], i: str = _I) -> str:
    quoted = ", ".join("'" + r.replace("'", "''") + "'" for r in rows)
    return f"[{quoted}][{i} % {len(rows)} + 1]"


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def _simple(name: str, rows: list[str], columns: dict, sql: dict[str, str]):
    """A query over one text t, made of the rows by the document's id."""
    picked = ", ".join(f"{v} AS {k}" for k, v in sql.items())

    @query(name, f"SELECT doc_id, {picked} FROM (SELECT doc_id, {_pick_sql(rows)} AS t FROM documents)")
    def run(spark, sf_dir):
        made = _docs(spark, sf_dir).select("doc_id", _pick(rows).alias("t"))
        return made.select("doc_id", *[f(F.col("t")).alias(k) for k, f in columns.items()])

    return run


_FOLD = "replace(replace(replace(replace({x}, 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), 'ø', 'o')"


@query("fold_text", f"SELECT doc_id, md5(strip_accents({_FOLD.format(x='lower(substr(text, 1, 400))')})) AS folded FROM documents WHERE NOT regexp_matches(substr(text, 1, 400), '[“”‘’–—]')")
def fold_text(spark, sf_dir):
    head = F.substring("text", 1, 400)
    return _docs(spark, sf_dir).filter(~head.rlike("[“”‘’–—]")).select("doc_id", F.md5(scalar.fold(head)).alias("folded"))


@query("fold_kept", "SELECT doc_id, md5(strip_accents(replace(replace(replace(substr(text, 1, 400), 'ß', 'ss'), 'œ', 'oe'), 'Œ', 'Oe'))) AS folded FROM documents WHERE NOT regexp_matches(substr(text, 1, 400), '[“”‘’–—]')")
def fold_kept(spark, sf_dir):
    head = F.substring("text", 1, 400)
    return _docs(spark, sf_dir).filter(~head.rlike("[“”‘’–—]")).select("doc_id", F.md5(rules.fold_kept(head)).alias("folded"))


@query("name_norm", r"SELECT doc_id, md5(array_to_string(regexp_extract_all(strip_accents(replace(lower(substr(text, 1, 400)), 'ß', 'ss')), '[\p{L}\p{N}_]+'), ' ')) AS name FROM documents")
def name_norm(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(rules.name_norm(F.substring("text", 1, 400))).alias("name"))


_simple("quote_norm", ["“Tom &amp; Co” – a  test", "L’État\u00a0c’est", "plain text", "„Zitat“ &lt;b&gt;"], {"quote": rules.quote_norm}, {"quote": """CASE WHEN t LIKE '“Tom%' THEN '"tom & co" - a test' WHEN t LIKE 'L%' THEN 'l''état c''est' WHEN t LIKE '„%' THEN '"zitat" <b>' ELSE t END"""})


@query("kept_places", r"SELECT doc_id, len(p)::BIGINT AS n, list_sum(p)::BIGINT AS total FROM (SELECT doc_id, list_filter(range(length(t)), lambda i: NOT regexp_matches(substr(t, i + 1, 1), '\s') OR (i > 0 AND NOT regexp_matches(substr(t, i, 1), '\s'))) AS p FROM (SELECT doc_id, replace(substr(text, 1, 200), ' of ', '  of' || chr(10) || ' ') AS t FROM documents))")
def kept_places(spark, sf_dir):
    made = F.replace(F.substring("text", 1, 200), F.lit(" of "), F.lit("  of\n "))
    p = _docs(spark, sf_dir).select("doc_id", rules.kept_places(made).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("english_texts", r"SELECT doc_id, len(w) > 0 AND len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'to', 'in', 'that', 'is', 'for', 'on', 'with', 'as', 'by', 'at', 'from', 'this'))) / greatest(len(w), 1) >= 0.05 AS english FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents)")
def english_texts(spark, sf_dir):
    words = F.array_remove(F.split(F.lower("text"), TOKEN_GAP), "")
    return _docs(spark, sf_dir).select("doc_id", words.alias("w")).select("doc_id", rules.is_english(F.col("w")).alias("english"))


@query("short_ids", "SELECT doc_id, substr(sha1(text), 1, 10) AS sid, substr(sha1(source || '|' || lang), 1, 8) AS key FROM documents")
def short_ids(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", rules.short_id(F.col("text")).alias("sid"), rules.short_id(F.concat_ws("|", "source", "lang"), 8).alias("key"))


_TITLES = ["Annual  Report 2019 (PDF, 2.3 MB)", "threat_assessment_2021.pdf", "Bericht 2020/21 - German version", "Summary of findings, English", "Report for 2018 [120 KB pdf] (FR)", "Download", "12 / 34", "Cyber Review 2017-2018"]
_TIDY = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\s*[(\[][^)\]]*\b(pdf|docx?|kb|mb)\b[^)\]]*[)\]]', '', 'g'), '(?i)\.(pdf|docx?|epub)$', ''), '_+', ' ', 'g'), '\s+', ' ', 'g'))"
_LAST = r"'[\s,:(–-]+(english|german|french|spanish|en|de|fr|es|summary|version)\)?$', ''"
_simple(
    "title_rules", _TITLES, {"tidy": rules.tidy_title, "key": rules.title_key, "series": rules.series_name, "poor": rules.is_poor_title},
    {"tidy": _TIDY, "key": f"regexp_replace(regexp_replace(regexp_replace(lower({_TIDY}), {_LAST}), {_LAST}), {_LAST})", "series": rf"trim(regexp_replace(regexp_replace({_TIDY}, '[\s,:(–-]*(for |of )?\b(19|20)[0-9]{{2}}([/-][0-9]{{2,4}})?\)?', '', 'g'), '\s+', ' ', 'g'))", "poor": r"lower(trim(t)) IN ('download', 'pdf', 'here', 'read more', 'more', 'link', '') OR regexp_matches(lower(trim(t)), '^[0-9\W]+$') OR length(trim(t)) < 4"},
)
_simple("heading_without_site", ["News | Example", "Example - Annual Report", "Example", "A | B", "Report – Example"], {"heading": lambda t: rules.without_site(t, F.lit("Example"))}, {"heading": "CASE t WHEN 'News | Example' THEN 'News' WHEN 'Example - Annual Report' THEN 'Annual Report' WHEN 'Report – Example' THEN 'Report' ELSE t END"})
_simple("era_years", ["令和5年版", "平成元年", "昭和60年 白書", "民國112年度", "2019年"], {"year": rules.other_calendar_year}, {"year": "CASE t WHEN '令和5年版' THEN 2023 WHEN '平成元年' THEN 1989 WHEN '昭和60年 白書' THEN 1985 WHEN '民國112年度' THEN 2023 END"})


@query("covered_years", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 2000 + doc_id % 20 WHEN 1 THEN 2011 WHEN 2 THEN 2019 END::INTEGER AS year FROM documents")
def covered_years(spark, sf_dir):
    i = F.col("doc_id")
    y = (2000 + i % 20).cast("string")
    text = F.when(i % 4 == 0, F.concat(F.lit("Annual Report "), y, F.lit(". Published May 2031. Review "), y)).when(i % 4 == 1, F.lit("Report 2010-11 and report 2009")).when(i % 4 == 2, F.lit("Bericht 2018/2019, report 2019, review 2017")).otherwise("No year here, published in 2013")
    return _docs(spark, sf_dir).select("doc_id", rules.covered_year(text, 2026).alias("year"))


_simple(
    "address_years", ["https://a.org/x?file=docs/Spring-2026.pdf", "https://a.org/20260611_report.pdf", "https://a.org/files/v20241008.pdf?x=1", "https://a.org/report-99.pdf", "https://a.org/get?id=7&name=plan_1985.pdf"],
    {"year": lambda t: rules.address_year(t, 2026)}, {"year": "CASE WHEN t LIKE '%Spring%' THEN 2026 WHEN t LIKE '%20260611%' THEN 2026 WHEN t LIKE '%20241008%' THEN 2024 END"},
)
_simple("birth_dates", ["10 Dec 1948", "December 28, 1951", "12/03/1960", "born 1948-12-10", "circa 1970", "unknown", "3 may 1999"], {"born": rules.birth_date}, {"born": "CASE t WHEN '10 Dec 1948' THEN '1948-12-10' WHEN 'December 28, 1951' THEN '1951-12-28' WHEN '12/03/1960' THEN '1960-03-12' WHEN 'born 1948-12-10' THEN '1948-12-10' WHEN 'circa 1970' THEN '1970' WHEN '3 may 1999' THEN '1999-05-03' ELSE '' END"})
_simple(
    "contact_details", ["+41 22 320 88 36; +41 22 320 74 00", "https://www.ghu.by/x", "VK.com/Name/wall", "info@Example.org ", "12 Long  Street, Minsk", "IMO 9187629", "Moscow"],
    {"phones": lambda t: F.array_join(rules.phones(t), ","), "web": rules.website, "email": rules.email, "street": rules.street, "imo": rules.imo_number, "number": rules.register_number},
    {
        "phones": r"array_to_string(list_filter(list_transform(regexp_split_to_array(t, '[,;/]|\bor\b|\band\b'), lambda p: regexp_replace(p, '[^0-9]', '', 'g')), lambda d: length(d) BETWEEN 8 AND 15), ',')",
        "web": "CASE t WHEN 'https://www.ghu.by/x' THEN 'ghu.by' WHEN 'VK.com/Name/wall' THEN 'vk.com/name' WHEN 'info@Example.org ' THEN 'example.org' ELSE '' END", "email": "CASE WHEN t LIKE 'info@%' THEN 'info@example.org' ELSE '' END",
        "street": r"CASE WHEN length(regexp_replace(t, '[^\p{L}\p{N}]+', '', 'g')) >= 10 AND regexp_matches(t, '[0-9]') THEN trim(regexp_replace(t, '\s+', ' ', 'g')) ELSE '' END", "imo": "CASE WHEN t = 'IMO 9187629' THEN '9187629' ELSE '' END", "number": "regexp_replace(upper(t), '[^0-9A-Z]', '', 'g')",
    },
)
_simple("remark_links", ["(Linked To: ALFA BANK). Also linked to BRAVO; other", "none"], {"names": lambda t: F.array_join(rules.linked_to(t), "|")}, {"names": "CASE WHEN t = 'none' THEN '' ELSE 'ALFA BANK|BRAVO' END"})
_simple("isbn_forms", ["0-306-40615-2", "080442957X", "978-3-16-148410-0", "x"], {"isbn": rules.isbn13, "ok": scalar.isbn_ok}, {"isbn": "CASE t WHEN '0-306-40615-2' THEN '9780306406157' WHEN '080442957X' THEN '9780804429573' WHEN '978-3-16-148410-0' THEN '9783161484100' ELSE 'X' END", "ok": "t <> 'x'"})
_simple("sentence_dates", ["On 3 March 2019 and in April 2020, not 2021.", "March 4, 2018: talks", "In 1999 or 2001", "no date"], {"dates": lambda t: F.array_join(rules.dates_in(t), ",")}, {"dates": "CASE WHEN t LIKE 'On%' THEN '2019-03-03,2020-04,2021' WHEN t LIKE 'March%' THEN '2018-03-04' WHEN t LIKE 'In%' THEN '1999,2001' ELSE '' END"})
_simple("one_edit", ["fancy baer", "fancy bear", "fancybear", "fancy bears", "fancy rbea", "cozy bear"], {"near": lambda t: rules.one_edit(t, F.lit("fancy bear"))}, {"near": "t IN ('fancy baer', 'fancy bear', 'fancybear', 'fancy bears')"})
_simple("company_words", ["ООО Газпром", "Alfa-Bank Ltd", "Щит и Меч"], {"latin": rules.latin, "words": lambda t: F.array_join(rules.distinctive(t), " ")}, {"latin": "CASE WHEN t LIKE 'ООО%' THEN 'ooo gazprom' WHEN t LIKE 'Щит%' THEN 'shchit i mech' ELSE lower(t) END", "words": "CASE WHEN t LIKE 'ООО%' THEN 'gazprom' WHEN t LIKE 'Щит%' THEN 'shchit mech' ELSE 'alfa bank' END"})
_simple("alias_lists", ["APT 1/Comment Crew fka Shady Rat (PLA)", "Unit 61398 < Army", "Solo"], {"names": lambda t: F.array_join(rules.aliases(t), "|")}, {"names": "CASE WHEN t LIKE 'APT%' THEN 'APT 1|Comment Crew|Shady Rat' WHEN t LIKE 'Unit%' THEN 'Unit 61398' ELSE t END"})
_WIKI = "{{Infobox group\n| name = North {{x}} Front\n| leader = [[Jan Novak|Novak]]\n| name = NF\n}}\nThe front {{cite|a={{b}}}} is led by [[Jan Novak]] and [[Petr#x]]."
_simple(
    "wikitext_rules", [_WIKI, "plain [[Link]] text"], {"plain": rules.without_templates, "links": lambda t: F.array_join(rules.wiki_links(t), "|"), "name": lambda t: F.coalesce(rules.infobox(t)["name"], F.lit(""))},
    {"plain": r"regexp_replace(regexp_replace(regexp_replace(t, '\{\{[^{}]*\}\}', '', 'g'), '\{\{[^{}]*\}\}', '', 'g'), '\{\{[^{}]*\}\}', '', 'g')", "links": "CASE WHEN t LIKE 'plain%' THEN 'Link' ELSE 'Jan Novak|Petr' END", "name": "CASE WHEN t LIKE 'plain%' THEN '' ELSE 'NF' END"},
)
_simple("relations_near", ["Alfa is owned by Bravo Corp today", "Against Alfa stood many", "Nothing about it", "Alfa" + " x" * 60 + " rival"], {"relation": lambda t: rules.relation_near(t, F.lit("Alfa"))}, {"relation": "CASE WHEN t LIKE '%owned%' THEN 'parent' WHEN t LIKE 'Against%' THEN 'rival' END"})
_simple("narrative_sentences", ["Dr. Who met Gen. Lee. Then A. Bee left! did he? Yes.", "One line"], {"n": lambda t: F.size(rules.narrative_sentences(t)), "first": lambda t: rules.narrative_sentences(t)[0]}, {"n": "CASE WHEN t LIKE 'Dr%' THEN 3 ELSE 1 END", "first": "CASE WHEN t LIKE 'Dr%' THEN 'Dr. Who met Gen. Lee.' ELSE t END"})


@query("passage_places", r"SELECT doc_id, place::INTEGER AS place, CASE WHEN place > 0 THEN 'Say: “the  quick, brown—fox” ran' END AS sentence FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 17 ELSE 0 END AS place FROM documents)")
def passage_places(spark, sf_dir):
    text = F.when(F.col("doc_id") % 2 == 0, F.lit("Before.   Say: “the  quick, brown—fox” ran. After")).otherwise("the brown quick fox")
    made = _docs(spark, sf_dir).select("doc_id", text.alias("t")).withColumn("place", rules.passage_place(F.col("t"), ["The", "quick", "brown", "fox"]))
    return made.select("doc_id", "place", F.regexp_replace(rules.widened(F.col("t"), F.col("place")), r"\.$", "").alias("sentence"))


_simple("slugs", ["Annual Report: 2019 / Part 2", "../etc/passwd", "/abs", "a/b.pdf", "C:\\x", "--x--"], {"slug": rules.slug, "safe": rules.is_safe_target}, {"slug": r"regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')", "safe": "t IN ('Annual Report: 2019 / Part 2', 'a/b.pdf', '--x--')"})
_simple("sniffed_files", ["%PDF-1.4", "PK\x03\x04zip", "<!doctype html>", "hello"], {"kind": lambda t: rules.sniffed(F.encode(t, "UTF-8"))}, {"kind": "CASE WHEN t LIKE '\\%PDF%' ESCAPE '\\' THEN 'pdf' WHEN t LIKE 'PK%' THEN 'zip' WHEN t LIKE '<%' THEN 'html' ELSE 'unknown' END"})


@query("ocr_candidates", "SELECT doc_id, n_chars < 100 * (1 + doc_id % 12) AS scan FROM documents")
def ocr_candidates(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", rules.needs_ocr(F.col("n_chars"), 1 + F.col("doc_id") % 12).alias("scan"))


@query("cleaned_pages", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(\p{Ll})-\n(\p{Ll})', '\1\2', 'g'), '[\x00-\x08\x0B-\x1F]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS page FROM (SELECT doc_id, replace(substr(text, 1, 500), 'on ', 'o-' || chr(10) || 'n  ' || chr(10) || chr(10) || chr(10)) AS t FROM documents)")
def cleaned_pages(spark, sf_dir):
    made = F.replace(F.substring("text", 1, 500), F.lit("on "), F.lit("o-\nn  \n\n\n"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(rules.cleaned_page(made)).alias("page"))


_simple("sentence_filters", ["Smith et al, pp. 3 (2019)", "12 34 56 a b", "A plain sentence of words.", "Table 2: budgets", "See https://x.org and (2020)"], {"references": rules.looks_like_references, "table": rules.looks_like_table}, {"references": "t LIKE 'Smith%' OR t LIKE 'See%'", "table": "t LIKE '12%' OR t LIKE 'Table%' OR t LIKE 'Smith%'"})


@query("language_cascade", "SELECT doc_id, coalesce(CASE doc_id % 3 WHEN 0 THEN 'de' END, CASE WHEN lang = 'en' THEN 'en' END, 'fr') AS guess FROM documents")
def language_cascade(spark, sf_dir):
    url = F.when(F.col("doc_id") % 3 == 0, F.lit("https://x.org/de/report.pdf")).otherwise("https://x.org/en/fr/report.pdf")
    langs = scalar.address_langs(url)
    by_text = F.when(F.col("lang") == "en", "en")
    return _docs(spark, sf_dir).select("doc_id", F.coalesce(F.when(F.size(langs) == 1, langs[0]), by_text, F.lit("fr")).alias("guess"))


@query("country_codes", "SELECT c_custkey, 'X' || CAST(n_nationkey AS VARCHAR) AS iso FROM customer JOIN nation ON n_nationkey = c_nationkey")
def country_codes(spark, sf_dir):
    names = read(spark, sf_dir, "nation").select(F.lower("n_name").alias("k"), F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("iso"), "n_nationkey")
    written = read(spark, sf_dir, "customer").join(names.select(F.col("n_nationkey").alias("c_nationkey"), F.upper("k").alias("country")), "c_nationkey")
    return written.select("c_custkey", F.lower("country").alias("k")).join(names.select("k", "iso"), "k").select("c_custkey", "iso")
