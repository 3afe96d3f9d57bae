"""Queries over names: preparation, matching in texts, matching between registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import matching
from quillon.operators.graph import components
from quillon.plans.registry import query
from quillon.sources.library import read
from quillon.sources.shared import keep

WORDS = ["Alfa", "Bravo", "Carlo", "Delta", "Echo", "Foxtro", "Golf", "Hotel", "India", "Julia", "Kilos", "Limas", "Mike", "Norma", "Oscar", "Papa"]
_W = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"


def _name(i):
    words = F.array(*[F.lit(w) for w in WORDS])
    pick = lambda n: F.element_at(words, (n + 1).cast("int"))
    return F.concat(pick(i % 16), F.lit(" "), pick(F.floor(i / 16) % 5), F.when(i % 5 == 0, F.concat(F.lit(" "), pick(F.floor(i / 3) % 7))).otherwise(""))


def _name_sql(i: str) -> str:
    return f"({_W}[{i} % 16 + 1] || ' ' || {_W}[({i} // 16) % 5 + 1] || CASE WHEN {i} % 5 = 0 THEN ' ' || {_W}[({i} // 3) % 7 + 1] ELSE '' END)"


#: actor, name, kind, label, manual
GAZETTEER = [
    ("P1", "Jana Novak", "person", "Jana Novak", False), ("P1", "Novak", "person", "Jana Novak", False), ("P1", "Jana", "person", "Jana Novak", False), ("P2", "Petr Novak", "person", "Petr Novak", False),
    ("P2", "Novak", "person", "Petr Novak", True), ("O1", "North Front (disbanded)", "armed", "North Front", False), ("O1", "NF", "armed", "North Front", False), ("O1", "The Front", "armed", "North Front", False),
    ("O2", "North Front", "party", "South Front", False), ("O2", "front", "party", "South Front", False), ("O3", "Group", "cyber", "Group", False), ("O3", "Owl", "cyber", "Group", False), ("O4", "OWL", "cyber", "OWL", False),
    ("O4", "(formerly)", "cyber", "OWL", False), ("O5", "a b", "cyber", "Ab Cd", False), ("O5", "Ab Cd", "cyber", "Ab Cd", False), ("O6", "Ignored Name", "armed", "Six", False), ("O6", "Six", "armed", "Six", False),
]


@query("names_prepared", r"""WITH g(actor, name, kind, label, manual) AS (VALUES """ + ", ".join(f"('{a}', '{n}', '{k}', '{l}', {str(m).upper()})" for a, n, k, l, m in GAZETTEER) + r"""),
t AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(name, '\([^)]*\)', ' ', 'g'), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS tokens, list_filter(regexp_split_to_array(label, '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS ltokens FROM g),
o AS (SELECT actor, tokens, min(name) AS name, bool_or(manual) AS manual, bool_or(kind = 'person') AS person, bool_or(tokens = ltokens) AS is_label, any_value(ltokens) AS ltokens FROM t GROUP BY actor, tokens),
s AS (SELECT *, count(*) OVER w AS owners, count_if(is_label AND NOT person) OVER w AS labelled, array_to_string(tokens, '') AS j, lower(array_to_string(tokens, ' ')) AS low, len(tokens) AS k FROM o WINDOW w AS (PARTITION BY tokens)),
r AS (SELECT *, CASE WHEN k = 0 THEN 'no letters' WHEN len(list_filter(tokens, lambda x: x <> lower(x))) = 0 THEN 'lowercase words' WHEN length(j) < 3 OR (k > 1 AND len(list_filter(tokens, lambda x: length(x) > 2)) = 0) THEN 'too short' WHEN low IN ('ignored name') THEN 'on the ignore list'
 WHEN k = 1 AND person AND NOT manual AND tokens[1] <> ltokens[-1] THEN 'one word that is not the surname' WHEN k = 1 AND low IN ('group', 'front') THEN 'a generic word' WHEN k = 1 AND length(j) = 3 AND j <> upper(j) THEN '3 letters without being an abbreviation'
 WHEN owners > 1 AND labelled = 1 AND k > 1 AND NOT is_label THEN 'the name of another actor' WHEN owners > 1 AND NOT (labelled = 1 AND k > 1) THEN 'shared' ELSE '' END AS reason FROM s)
SELECT actor, name, low AS tokens, manual, person, CASE WHEN reason = '' THEN 'used' ELSE 'ignored' END AS status, reason FROM r""")
def names_prepared(spark, sf_dir):
    g = spark.createDataFrame(GAZETTEER, "actor string, name string, kind string, label string, manual boolean")
    return matching.prepared(g, ["ignored name"], ["group", "front"]).withColumn("tokens", F.lower(F.array_join("tokens", " ")))


#: actor, name, manual: names of the tables' invented prose.
TEXT_NAMES = [("Q1", "In the", False), ("Q1", "Tion", False), ("Q2", "Is and", False), ("Q3", "The", False), ("Q3", "The and", False), ("Q4", "Erin", False), ("Q5", "Thre", False), ("Q6", "Ertio", True), ("Q6", "Of the", False), ("Q7", "An", False)]
_FOUND_SQL = r"""WITH names(actor, name, manual) AS (VALUES """ + ", ".join(f"('{a}', '{n}', {str(m).upper()})" for a, n, m in TEXT_NAMES) + r"""),
n AS (SELECT *, string_split(name, ' ') AS tokens FROM names), w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w))) AS "at" FROM w), q AS (SELECT *, w["at" + 1] AS word FROM p),
h AS (SELECT DISTINCT doc_id, actor, name, "at", "at" + len(tokens) AS upto FROM q JOIN n ON word = tokens[1] WHERE w["at" + 1:"at" + len(tokens)] = tokens AND (name <> 'The' OR len(list_filter(list_concat(w[greatest("at" - 5, 1):"at"], w["at" + 2:"at" + 7]), lambda x: regexp_matches(x, '(?i)rea'))) > 0)
UNION SELECT DISTINCT doc_id, actor, name, "at", "at" + 1 FROM q JOIN n ON manual AND len(tokens) = 1 AND length(name) >= 5 WHERE length(word) - length(name) BETWEEN 1 AND 3 AND starts_with(word, name) AND regexp_matches(substr(word, length(name) + 1), '^\p{Ll}+$')
UNION SELECT DISTINCT doc_id, actor, name, "at", "at" + len(tokens) FROM q JOIN n ON word = upper(tokens[1]) WHERE length(replace(name, ' ', '')) >= 6 AND array_to_string(w["at" + 1:"at" + len(tokens)], ' ') = upper(name) AND upper(name) <> name)"""


def _names(spark):
    rows = spark.createDataFrame(TEXT_NAMES, "actor string, name string, manual boolean")
    return rows.select("actor", "name", matching.name_tokens(F.col("name")).alias("tokens"), "manual", F.lit(False).alias("person"))


def _found(spark, sf_dir):
    return matching.found(read(spark, sf_dir, "documents"), _names(spark), {"The": ["rea"]})


@query("names_found", _FOUND_SQL + ' SELECT doc_id, actor, name, "at", upto FROM h')
def names_found(spark, sf_dir):
    return _found(spark, sf_dir)


_LONGEST_SQL = _FOUND_SQL + r""", l AS (SELECT doc_id, list({'e': upto, 's': "at", 'o': '|' || actor || ':' || name || ':' || CAST("at" AS VARCHAR) || ':' || CAST(upto AS VARCHAR)} ORDER BY "at", upto DESC, name, actor) AS hits FROM h GROUP BY doc_id),
k AS (SELECT doc_id, list_reduce(list_prepend({'e': 0::BIGINT, 's': -1::BIGINT, 'o': ''}, hits), lambda a, x: CASE WHEN x.s >= a.e THEN {'e': x.e, 's': x.s, 'o': a.o || x.o} ELSE a END).o AS o FROM l),
m AS (SELECT doc_id, string_split(unnest(string_split(substr(o, 2), '|')), ':') AS x FROM k)"""


@query("names_longest", _LONGEST_SQL + ' SELECT doc_id, x[1] AS actor, x[2] AS name, CAST(x[3] AS INTEGER) AS "at", CAST(x[4] AS INTEGER) AS upto FROM m')
def names_longest(spark, sf_dir):
    return matching.longest(_found(spark, sf_dir))


@query("names_corroborated", _LONGEST_SQL + ", c AS (SELECT m.doc_id, x[1] AS actor, x[2] AS name FROM m JOIN documents d ON d.doc_id = m.doc_id WHERE x[2] <> 'An' AND NOT (x[1] = 'Q1' AND source = 'src1') AND NOT (x[1] = 'Q2' AND m.doc_id % 10 = 0)) SELECT doc_id, actor, count(*) AS hits, count(DISTINCT name) AS names FROM c GROUP BY doc_id, actor HAVING bool_or(name NOT IN ('The', 'In the')) OR count(DISTINCT name) > 1")
def names_corroborated(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    hits = matching.longest(_found(spark, sf_dir)).join(docs, "doc_id")
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    wrong = docs.filter("doc_id % 10 = 0").select(F.lit("Q2").alias("actor"), "doc_id")
    return matching.corroborated(hits, one([("The",), ("In the",)], "name string"), one([("An",)], "name string"), one([("Q1", "src1")], "actor string, source string"), wrong)


_ENTRIES_SQL = f"""WITH e AS (SELECT c_custkey AS id, c_custkey AS place, ['UN', 'EU', 'US', 'UK'][c_custkey % 4 + 1] AS list, CASE WHEN c_custkey % 3 = 0 THEN 'group' ELSE 'person' END AS type, {_name_sql('c_custkey')} AS name, c_custkey % 7 = 0 AS alias,
CASE WHEN c_custkey % 6 = 0 THEN CAST(100000 + c_custkey % 60 AS VARCHAR) END AS number, CASE WHEN c_custkey % 50 = 1 THEN c_custkey - 1 END AS reference, CASE c_custkey % 10 WHEN 0 THEN '1970' WHEN 1 THEN '1971' ELSE '19' || CAST(60 + c_custkey % 4 AS VARCHAR) || '-01-0' || CAST(1 + c_custkey % 3 AS VARCHAR) END AS birth, c_nationkey AS nation FROM customer)"""


def _entries(spark, sf_dir):
    i = F.col("c_custkey")
    birth = F.when(i % 10 == 0, "1970").when(i % 10 == 1, "1971").otherwise(F.concat(F.lit("19"), (60 + i % 4).cast("string"), F.lit("-01-0"), (1 + i % 3).cast("string")))
    return read(spark, sf_dir, "customer").select(
        i.alias("id"), i.alias("place"), F.element_at(F.array(*[F.lit(x) for x in ("UN", "EU", "US", "UK")]), (i % 4 + 1).cast("int")).alias("list"), F.when(i % 3 == 0, "group").otherwise("person").alias("type"), _name(i).alias("name"),
        (i % 7 == 0).alias("alias"), F.when(i % 6 == 0, (100000 + i % 60).cast("string")).alias("number"), F.when(i % 50 == 1, i - 1).alias("reference"), birth.alias("birth"), F.col("c_nationkey").alias("nation"),
    )


_ACTORS_SQL = f", a AS (SELECT s_suppkey AS actor, CASE WHEN s_suppkey % 2 = 0 THEN 'person' ELSE 'armed' END AS kind, {_name_sql('(s_suppkey * 3)')} AS name FROM supplier)"


def _actors(spark, sf_dir):
    i = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(i.alias("actor"), F.when(i % 2 == 0, "person").otherwise("armed").alias("kind"), _name(i * 3).alias("name"))


@query("listed_actors", _ENTRIES_SQL + _ACTORS_SQL + """, o AS (SELECT *, count(*) OVER (PARTITION BY t, k) AS owners FROM (SELECT DISTINCT actor, CASE WHEN kind = 'person' THEN 'person' ELSE 'group' END AS t, lower(name) AS k FROM a))
SELECT list, id, actor, CASE WHEN min(CASE WHEN alias THEN 1 ELSE 0 END) = 0 THEN 'name' ELSE 'alias' END AS via FROM e JOIN o ON o.t = e.type AND o.k = lower(e.name) AND owners = 1 GROUP BY list, id, actor""")
def listed_actors(spark, sf_dir):
    return matching.listed_actors(_entries(spark, sf_dir), _actors(spark, sf_dir))


_EDGES_SQL = _ENTRIES_SQL + """, f AS (SELECT *, list_sort(list_distinct(string_split(lower(name), ' '))) AS words FROM e), k AS (SELECT *, array_to_string(words, ' ') AS key FROM f),
one AS (SELECT k.reference AS a, k.id AS b, 1 AS rule, k.place FROM k JOIN k o ON o.id = k.reference AND o.list <> k.list),
two AS (SELECT h.id AS a, k.id AS b, 2 AS rule, k.place FROM k JOIN k h ON h.number = k.number AND h.place = (SELECT min(place) FROM k z WHERE z.number = k.number) WHERE k.id <> h.id AND k.list <> h.list AND list_has_any(k.words, h.words)),
people AS (SELECT * FROM k WHERE type = 'person' AND len(words) >= 2 AND length(key) >= 8),
full_ AS (SELECT h.id AS a, k.id AS b, 3 AS rule, k.place FROM (SELECT *, min(place) OVER (PARTITION BY key, birth) AS head FROM people WHERE length(birth) = 10) k JOIN k h ON h.place = head WHERE k.id <> h.id AND k.list <> h.list),
year_ AS (SELECT h.id AS a, k.id AS b, 3 AS rule, k.place FROM (SELECT *, min(place) OVER (PARTITION BY key, substr(birth, 1, 4)) AS head FROM people WHERE len(words) >= 3) k JOIN k h ON h.place = head WHERE k.id <> h.id AND k.list <> h.list),
orgs AS (SELECT *, max(n) OVER (PARTITION BY type, key) AS worst FROM (SELECT *, count(*) OVER (PARTITION BY type, list, key) AS n FROM k WHERE type <> 'person' AND len(words) >= 2 AND length(key) >= 8)),
org_ AS (SELECT h.id AS a, k.id AS b, 3 AS rule, k.place FROM (SELECT *, min(place) OVER (PARTITION BY type, key) AS head FROM orgs WHERE worst = 1) k JOIN k h ON h.place = head WHERE k.id <> h.id AND k.list <> h.list)"""


@query("identity_edges", _EDGES_SQL + " SELECT * FROM one UNION SELECT * FROM two UNION SELECT * FROM full_ UNION SELECT * FROM year_ UNION SELECT * FROM org_")
def identity_edges(spark, sf_dir):
    return matching.identity_edges(_entries(spark, sf_dir))


@query("identities")
def identities(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    edges = keep(matching.identity_edges(entries), "identity-edges")
    return matching.identities(entries, edges, lambda e: components(e, lambda df: keep(df, "identity-parts")))


@query("shared_details", _ENTRIES_SQL + ", d AS (SELECT id AS target, 'number' AS kind, number AS key FROM e WHERE number IS NOT NULL UNION ALL SELECT id, 'born', birth FROM e WHERE length(birth) = 10) SELECT kind, key, count(DISTINCT target) AS targets FROM d GROUP BY kind, key HAVING count(DISTINCT target) >= 2")
def shared_details(spark, sf_dir):
    e = _entries(spark, sf_dir)
    d = e.filter("number is not null").select(F.col("id").alias("target"), F.lit("number").alias("kind"), F.col("number").alias("key")).unionByName(e.filter("length(birth) = 10").select(F.col("id").alias("target"), F.lit("born").alias("kind"), F.col("birth").alias("key")))
    return matching.shared_details(d)


_REGISTER_SQL = f", r AS (SELECT 'R' || CAST(p_partkey AS VARCHAR) AS lei, {_name_sql('(p_partkey * 5)')} AS name, p_size % 25 AS country, CAST(100000 + p_partkey % 80 AS VARCHAR) AS number FROM part), c AS (SELECT id AS company, name, nation AS country, number, CASE WHEN id % 40 = 0 THEN 'R' || CAST(id // 4 AS VARCHAR) END AS lei FROM e WHERE type = 'group')"


@query("company_records", _ENTRIES_SQL + _REGISTER_SQL + """, m AS (SELECT company, r.lei AS record, 1 AS rank FROM c JOIN r ON r.lei = c.lei UNION SELECT company, r.lei, 2 FROM c JOIN r ON r.number = c.number AND r.country = c.country WHERE list_has_any(string_split(lower(c.name), ' '), string_split(lower(r.name), ' ')) UNION SELECT company, r.lei, 3 FROM c JOIN r ON lower(r.name) = lower(c.name) AND r.country = c.country),
b AS (SELECT company, rank, list(DISTINCT record ORDER BY record) AS rs FROM m WHERE rank = (SELECT min(rank) FROM m z WHERE z.company = m.company) GROUP BY company, rank) SELECT company, ['lei', 'registration', 'name'][rank] AS how, array_to_string(rs, ',') AS records FROM b WHERE rank < 3 OR len(rs) = 1""")
def company_records(spark, sf_dir):
    e = _entries(spark, sf_dir).filter("type = 'group'")
    companies = e.select(F.col("id").alias("company"), "name", F.col("nation").alias("country"), "number", F.when(F.col("id") % 40 == 0, F.concat(F.lit("R"), F.floor(F.col("id") / 4).cast("string"))).alias("lei"))
    p = F.col("p_partkey")
    register = read(spark, sf_dir, "part").select(F.concat(F.lit("R"), p.cast("string")).alias("lei"), _name(p * 5).alias("name"), (F.col("p_size") % 25).alias("country"), (100000 + p % 80).cast("string").alias("number"))
    return matching.company_records(companies, register)


@query("offshore_records", _ENTRIES_SQL + f", n AS (SELECT s_suppkey AS node, s_nationkey % 3 AS country, lower({_name_sql('s_suppkey')}) AS key FROM supplier), g AS (SELECT key, list(DISTINCT country) AS cs, list(DISTINCT node ORDER BY node) AS ns FROM n GROUP BY key) SELECT id AS subject, CASE WHEN type = 'person' THEN 'person' ELSE 'company' END AS how, array_to_string(ns, ',') AS nodes FROM e JOIN g ON g.key = lower(e.name) WHERE len(cs) = 1 AND cs[1] = nation % 3 AND (type <> 'person' OR len(ns) <= 3)")
def offshore_records(spark, sf_dir):
    e = _entries(spark, sf_dir).select(F.col("id").alias("subject"), "type", "name", (F.col("nation") % 3).alias("country"))
    nodes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), _name(F.col("s_suppkey")).alias("name"), (F.col("s_nationkey") % 3).alias("country"))
    return matching.offshore_records(e, nodes)


@query("vendor_aliases", f"""WITH v AS (SELECT p_partkey AS group_id, CASE WHEN p_partkey % 9 = 0 THEN p_partkey // 9 END AS code, lower({_name_sql('(p_partkey * 7)')}) AS k FROM part), a AS (SELECT s_suppkey AS actor, s_suppkey AS code, lower({_name_sql('s_suppkey')}) AS k FROM supplier),
byc AS (SELECT group_id, actor, 'code' AS how FROM v JOIN a USING (code)), vn AS (SELECT *, count(*) OVER (PARTITION BY k) AS g FROM (SELECT DISTINCT group_id, k FROM v)), an AS (SELECT *, count(*) OVER (PARTITION BY k) AS o FROM (SELECT DISTINCT actor, k FROM a))
SELECT * FROM byc UNION ALL SELECT group_id, min(actor), 'name' FROM vn JOIN an USING (k) WHERE g = 1 AND o = 1 AND group_id NOT IN (SELECT group_id FROM byc) GROUP BY group_id HAVING count(DISTINCT actor) = 1""")
def vendor_aliases(spark, sf_dir):
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    vendor = read(spark, sf_dir, "part").select(p.alias("group_id"), F.when(p % 9 == 0, F.floor(p / 9)).alias("code"), _name(p * 7).alias("name"))
    return matching.vendor_aliases(vendor, read(spark, sf_dir, "supplier").select(s.alias("actor"), s.alias("code"), _name(s).alias("name")))


_SAID_SQL = f"t AS (SELECT s_suppkey AS sentence_id, 'Then ' || {_name_sql('s_suppkey')} || ' met alfa Bravo and ' || {_name_sql('(s_suppkey + 3)')} AS text FROM supplier)"
_TABLE_SQL = f"n AS (SELECT lower({_name_sql('(p_partkey * 5)')}) AS key, p_partkey % 40 AS actor FROM part UNION ALL SELECT 'bravo', 1000 UNION ALL SELECT 'alfa', 1001), k AS (SELECT key, CASE WHEN count(DISTINCT actor) = 1 THEN min(actor) END AS actor FROM n GROUP BY key)"


@query("narrative_names", rf"""WITH {_SAID_SQL}, {_TABLE_SQL}, w AS (SELECT sentence_id, list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '') AS w FROM t), g AS (SELECT sentence_id, w, "at", n FROM (SELECT *, unnest(range(len(w))) AS "at" FROM w), (SELECT unnest([1, 2, 3]) AS n) WHERE "at" + n <= len(w)),
h AS (SELECT sentence_id, "at", n, key, actor FROM g JOIN k ON key = lower(array_to_string(w["at" + 1:"at" + n], ' ')) WHERE n > 1 OR regexp_matches(w["at" + 1], '^\p{{Lu}}')),
l AS (SELECT sentence_id, list_reduce(list_prepend({{'e': 0::BIGINT, 's': -1::BIGINT, 'o': ''}}, list({{'e': "at" + n, 's': "at", 'o': '|' || CAST("at" AS VARCHAR) || ':' || key || ':' || coalesce(CAST(actor AS VARCHAR), '')}} ORDER BY "at", n DESC)), lambda a, x: CASE WHEN x.s >= a.e THEN {{'e': x.e, 's': x.s, 'o': a.o || x.o}} ELSE a END).o AS o FROM h GROUP BY sentence_id),
m AS (SELECT sentence_id, string_split(unnest(string_split(substr(o, 2), '|')), ':') AS x FROM l) SELECT sentence_id, CAST(x[1] AS INTEGER) AS "at", x[2] AS key, CASE WHEN x[3] <> '' THEN CAST(x[3] AS BIGINT) END AS actor FROM m""")
def narrative_names(spark, sf_dir):
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    said = read(spark, sf_dir, "supplier").select(s.alias("sentence_id"), F.concat(F.lit("Then "), _name(s), F.lit(" met alfa Bravo and "), _name(s + 3)).alias("text"))
    names = read(spark, sf_dir, "part").select(_name(p * 5).alias("name"), (p % 40).cast("int").alias("actor")).unionByName(spark.createDataFrame([("Bravo", 1000), ("Alfa", 1001)], "name string, actor int"))
    return matching.narrative_names(said, names)


@query("wanted_actors", _ENTRIES_SQL + _ACTORS_SQL + ", o AS (SELECT k, min(actor) AS actor, count(DISTINCT actor) AS owners FROM (SELECT actor, lower(name) AS k FROM a WHERE kind = 'person') GROUP BY k) SELECT id AS notice, actor FROM e JOIN o ON k = lower(name) WHERE owners = 1 AND type = 'person'")
def wanted_actors(spark, sf_dir):
    notices = _entries(spark, sf_dir).filter("type = 'person'").select(F.col("id").alias("notice"), "name")
    return matching.wanted_actors(notices, _actors(spark, sf_dir))


@query("top_connections", "SELECT actor, rel, other, rank FROM (SELECT actor, rel, other, row_number() OVER (PARTITION BY actor, rel ORDER BY v DESC, other)::INTEGER AS rank FROM (SELECT l_suppkey AS actor, l_returnflag AS rel, l_partkey AS other, max(l_quantity) AS v FROM lineitem GROUP BY ALL)) WHERE rank <= 25")
def top_connections(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("actor"), F.col("l_returnflag").alias("rel"), F.col("l_partkey").alias("other")).agg(F.max("l_quantity").alias("notability"))
    return matching.top_connections(l)


@query("review_summary", "SELECT source AS name, count(l.doc_id) AS judged, coalesce(sum(quality), 0)::BIGINT AS right, CASE WHEN count(l.doc_id) > 0 THEN round(avg(quality), 4) END AS precision, count(l.doc_id) >= 5 AS done, count(*) AS hits FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def review_summary(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    names = docs.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("hits"))
    verdicts = labels.join(docs.select("doc_id", F.col("source").alias("name")), "doc_id").select("name", "doc_id", (F.col("quality") == 1).alias("right"))
    return matching.review_summary(verdicts, names)
