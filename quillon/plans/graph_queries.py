"""Queries over graphs and names, made of orders, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import graph, names
from quillon.plans.registry import query
from quillon.sources.library import read
from quillon.sources.shared import keep

# Ties between customers (even ids) and parts (odd ids); the layer is the order's priority.
_TIES = "ties AS (SELECT DISTINCT o_custkey * 2 AS a, l_partkey * 2 + 1 AS b, o_orderpriority AS layer FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_NEAR = _TIES + ", near AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM ties UNION ALL SELECT b, a FROM ties) WHERE a <> b)"


def ties(spark, sf_dir) -> DataFrame:
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    joined = l.join(o, l.l_orderkey == o.o_orderkey)
    return joined.select((F.col("o_custkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"), F.col("o_orderpriority").alias("layer")).distinct()


@query("graph_degrees", f"WITH {_NEAR} SELECT a AS node, count(*) AS degree FROM near GROUP BY a")
def graph_degrees(spark, sf_dir):
    return graph.degrees(ties(spark, sf_dir))


@query("graph_crossroads", f"WITH {_TIES} SELECT node, count(DISTINCT layer) AS layers, count(DISTINCT other) AS neighbours FROM (SELECT a AS node, b AS other, layer FROM ties UNION ALL SELECT b, a, layer FROM ties) GROUP BY node HAVING count(DISTINCT layer) >= 3")
def graph_crossroads(spark, sf_dir):
    return graph.crossroads(ties(spark, sf_dir))


@query("graph_layers", f"WITH {_TIES} SELECT layer, count(*) AS ties, count(DISTINCT a) AS customers, count(DISTINCT b) AS parts FROM ties GROUP BY layer")
def graph_layers(spark, sf_dir):
    return ties(spark, sf_dir).groupBy("layer").agg(F.count("*").alias("ties"), F.count_distinct("a").alias("customers"), F.count_distinct("b").alias("parts"))


@query("graph_components", f"""WITH RECURSIVE {_NEAR}, reach(node, seen) AS (SELECT a, a FROM near UNION SELECT near.b, reach.seen FROM reach JOIN near ON near.a = reach.node WHERE reach.seen < near.b),
l AS (SELECT node, min(seen) AS component FROM reach GROUP BY node) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM l""")
def graph_components(spark, sf_dir):
    return graph.components(ties(spark, sf_dir), checkpoint=lambda df: keep(df, "labels"))


@query("graph_leads", f"WITH {_NEAR}, w AS (SELECT a AS w, 1 / ln(count(*)) AS v FROM near GROUP BY a HAVING count(*) BETWEEN 2 AND 200) SELECT x.b AS a, y.b AS b, count(*) AS shared, round(sum(v), 6) AS score FROM near x JOIN near y ON x.a = y.a AND x.b < y.b JOIN w ON w.w = x.a WHERE NOT EXISTS (SELECT 1 FROM near z WHERE z.a = x.b AND z.b = y.b) GROUP BY ALL HAVING count(*) >= 2")
def graph_leads(spark, sf_dir):
    return graph.all_leads(_links(spark, sf_dir), _saved)


@query("graph_brokers", f"WITH {_NEAR}, d AS (SELECT p_partkey * 2 + 1 AS node, p_brand AS domain FROM part UNION ALL SELECT c_custkey * 2, c_mktsegment FROM customer), c AS (SELECT a, domain, count(*) AS n FROM near JOIN d ON node = b GROUP BY ALL) SELECT a AS node, array_to_string(list(n ORDER BY n DESC), ',') AS reach, list(n ORDER BY n DESC)[2] AS score FROM c GROUP BY a HAVING count(*) >= 2")
def graph_brokers(spark, sf_dir):
    domains = read(spark, sf_dir, "part").select((F.col("p_partkey") * 2 + 1).alias("node"), F.col("p_brand").alias("domain")).unionByName(read(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("node"), F.col("c_mktsegment").alias("domain")))
    return graph.brokers(ties(spark, sf_dir), domains).withColumn("reach", F.array_join(F.transform("reach", lambda x: x.cast("string")), ","))


_HOLDS = "holds AS (SELECT DISTINCT l_suppkey AS owner, l_partkey AS item FROM lineitem)"


@query("graph_twins", f"WITH {_HOLDS}, i AS (SELECT item, ln((SELECT count(DISTINCT owner) FROM holds) / count(*)) AS w FROM holds GROUP BY item), t AS (SELECT owner, sum(w) AS s FROM holds JOIN i USING (item) GROUP BY owner), p AS (SELECT x.owner AS a, y.owner AS b, count(*) AS shared, sum(w) AS s FROM holds x JOIN holds y ON x.item = y.item AND x.owner < y.owner JOIN i ON i.item = x.item GROUP BY ALL HAVING count(*) >= 5) SELECT a, b, shared, CASE WHEN ta.s + tb.s - p.s > 0 THEN round(p.s / (ta.s + tb.s - p.s), 6) ELSE 0 END AS score FROM p JOIN t ta ON ta.owner = a JOIN t tb ON tb.owner = b")
def graph_twins(spark, sf_dir):
    holds = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("item"))
    return graph.twins(holds)


@query("graph_associations", "WITH h AS (SELECT DISTINCT l_orderkey AS basket, l_suppkey AS item FROM lineitem), n AS (SELECT count(DISTINCT basket) AS n FROM h), k AS (SELECT item, count(*) AS k FROM h GROUP BY item), p AS (SELECT x.item AS a, y.item AS b, count(*) AS c FROM h x JOIN h y ON x.basket = y.basket AND x.item < y.item GROUP BY ALL HAVING count(*) >= 3) SELECT a, b, c AS n, CASE WHEN c >= ka.k AND c >= kb.k THEN 1 WHEN c >= n THEN 0 ELSE greatest(0, round(ln(c::DOUBLE * n / (ka.k * kb.k)) / -ln(c::DOUBLE / n), 6)) END::DOUBLE AS npmi FROM p JOIN k ka ON ka.item = a JOIN k kb ON kb.item = b, n")
def graph_associations(spark, sf_dir):
    return graph.associations(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_suppkey").alias("item")))


@query("graph_path")
def graph_path(spark, sf_dir):
    links = _links(spark, sf_dir)
    start, end = graph.best_lead(links, _saved, least=1) or (0, 1)
    found = graph.paths(links.withColumn("cost", F.lit(1.0)), start, end, checkpoint=_saved)
    return found.select(_written("path").alias("path"), "cost")


def _links(spark, sf_dir) -> DataFrame:
    """The ties without layers, repeats included."""
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return _saved(l.join(o, l.l_orderkey == o.o_orderkey).select((F.col("o_custkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")))


def _saved(df: DataFrame) -> DataFrame:
    return keep(df, "frontier")


def _written(path: str):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


# A small graph of places and markets: nations, their regions and the market segments that many of their customers are in.
_PLACES_SQL = """WITH RECURSIVE c AS (SELECT c_nationkey AS n, c_mktsegment AS s, count(*) AS k FROM customer GROUP BY ALL), t AS (SELECT n_nationkey::BIGINT AS a, 100 + n_regionkey::BIGINT AS b, 'official' AS layer FROM nation UNION SELECT n, 200 + (SELECT count(DISTINCT s) FROM c z WHERE z.s < c.s), 'reports' FROM c WHERE k * 25 >= (SELECT sum(k) FROM c z WHERE z.s = c.s)),
e AS (SELECT a, b, min(CASE layer WHEN 'official' THEN 1.0::DOUBLE ELSE 1.75::DOUBLE END) AS cost FROM (SELECT a, b, layer FROM t UNION ALL SELECT b, a, layer FROM t) GROUP BY a, b), d AS (SELECT a AS n, 0.5::DOUBLE * log2(1 + count(*)) AS toll FROM e GROUP BY a),
w(spot, arrived, so_far, path) AS (SELECT 1::BIGINT, 0::DOUBLE, 0::DOUBLE, [1::BIGINT] UNION ALL SELECT e.b, so_far + cost, so_far + cost + toll, list_append(path, e.b) FROM w JOIN e ON e.a = w.spot JOIN d ON d.n = e.b WHERE len(path) <= 4 AND NOT list_contains(path, e.b) AND spot <> 18),
f AS (SELECT path, arrived AS cost FROM w WHERE spot = 18),
p1 AS (SELECT * FROM f ORDER BY round(cost, 6), len(path), path LIMIT 1), p2 AS (SELECT * FROM f WHERE NOT list_has_any(path, (SELECT path[2:-2] FROM p1)) ORDER BY round(cost, 6), len(path), path LIMIT 1),
p3 AS (SELECT * FROM f WHERE NOT list_has_any(path, (SELECT path[2:-2] FROM p1)) AND NOT list_has_any(path, (SELECT path[2:-2] FROM p2)) ORDER BY round(cost, 6), len(path), path LIMIT 1)"""


def places(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    c = read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("k"))
    names = c.select("c_mktsegment").distinct().withColumn("s", F.row_number().over(Window.orderBy("c_mktsegment")) - 1)  # five segments
    total = c.groupBy("c_mktsegment").agg(F.sum("k").alias("total"))
    named = c.join(names, "c_mktsegment").join(total, "c_mktsegment").filter("k * 25 >= total")
    market = named.select(F.col("c_nationkey").cast("long").alias("a"), (200 + F.col("s")).cast("long").alias("b"), F.lit("reports").alias("layer"))
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"), (100 + F.col("n_regionkey")).cast("long").alias("b"), F.lit("official").alias("layer")).unionByName(market)


@query("graph_chains", _PLACES_SQL + " SELECT 1 AS place, array_to_string(path, '>') AS path, round(cost, 6) AS cost FROM p1 UNION ALL SELECT 2, array_to_string(path, '>'), round(cost, 6) FROM p2 UNION ALL SELECT 3, array_to_string(path, '>'), round(cost, 6) FROM p3")
def graph_chains(spark, sf_dir):
    found = graph.alternatives(graph.layer_costs(places(spark, sf_dir)), 1, 18, k=3, steps=4, checkpoint=_saved)
    return spark.createDataFrame([(i + 1, ">".join(map(str, p)), float(c)) for i, (p, c) in enumerate(found)], "place int, path string, cost double")


@query("graph_case_file")
def graph_case_file(spark, sf_dir):
    pins = spark.createDataFrame([(1,), (7,), (18,), (24,)], "node long")
    grid, connectors = graph.case_file(graph.layer_costs(places(spark, sf_dir)), pins, steps=4, checkpoint=_saved)
    chains = grid.select("start", "end", _written("path").alias("path"), "cost")
    return chains.unionByName(connectors.select(F.lit(None).cast("long").alias("start"), F.col("node").alias("end"), F.lit("connector").alias("path"), F.col("chains").cast("double").alias("cost")))


@query("graph_matrix", f"WITH {_TIES}, s AS (SELECT DISTINCT a, b, layer FROM (SELECT * FROM ties UNION ALL SELECT b, a, layer FROM ties)), i AS (SELECT b AS node FROM s WHERE a = 3 GROUP BY b ORDER BY count(*) DESC, b LIMIT 60) SELECT a, b, count(*) AS links FROM (SELECT DISTINCT a.node AS a, b.node AS b, s.b AS via FROM i a JOIN s ON s.a = a.node JOIN s t ON t.b = s.b JOIN i b ON b.node = t.a WHERE a.node < b.node AND s.b <> 3) GROUP BY a, b")
def graph_matrix(spark, sf_dir):
    t = ties(spark, sf_dir)
    sym = t.select("a", "b").unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    inner = t.unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b"), "layer")).filter("a = 3").distinct().groupBy("b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "b").limit(60).select(F.col("b").alias("node"))
    reach = F.broadcast(inner.withColumnRenamed("node", "a"))  # 60 rows
    ends = sym.join(reach, "a", "left_semi").filter("b <> 3")
    linked = ends.select("a", F.col("b").alias("via")).join(ends.select(F.col("a").alias("c"), F.col("b").alias("via")), "via").filter("a < c")
    return linked.groupBy("a", F.col("c").alias("b")).agg(F.count("*").alias("links"))


@query("graph_ego", _PLACES_SQL + ", i AS (SELECT DISTINCT CASE WHEN a = 101 THEN b ELSE a END AS node FROM t WHERE a = 101 OR b = 101), j AS (SELECT node FROM i UNION SELECT b FROM t JOIN i ON a = node WHERE b >= 200) SELECT a, b, count(DISTINCT layer) AS links FROM t JOIN j x ON x.node = a JOIN j y ON y.node = b GROUP BY a, b")
def graph_ego(spark, sf_dir):
    t = places(spark, sf_dir)
    hub = t.filter("b = 101").select(F.col("a").alias("node"))
    # one more node ties the region's nations and their markets together, so the neighbourhood has ties of its own
    near = hub.unionByName(t.join(hub, F.col("a") == F.col("node"), "left_semi").filter("b >= 200").select(F.col("b").alias("node"))).distinct()
    return graph.ego_matrix(t.unionByName(near.select(F.lit(-1).cast("long").alias("a"), F.col("node").alias("b"), F.lit("center").alias("layer"))), -1)


@query("graph_canonical", "SELECT a, b, rel, layer, max(weight) AS weight FROM (SELECT o_custkey - o_custkey % 3 AS a, l_suppkey - l_suppkey % 3 AS b, l_returnflag AS rel, o_orderpriority AS layer, l_quantity AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE a <> b GROUP BY a, b, rel, layer")
def graph_canonical(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    t = l.select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("rel"), F.col("o_orderpriority").alias("layer"), F.col("l_quantity").alias("weight"))
    roots = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_custkey") - F.col("c_custkey") % 3).alias("root")).filter("root <> node")
    return graph.canonical(t, roots)


@query("graph_entity", "SELECT n_nationkey AS id, n_name AS label FROM nation WHERE n_nationkey IN (4, 9)")
def graph_entity(spark, sf_dir):
    e = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return graph.entity(e, "nation_4").unionByName(graph.entity(e, "Nation [9]")).unionByName(graph.entity(e, "NATION"))


@query("event_relations", "WITH f AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT a, b, CASE WHEN a % 100 = 7 THEN 'caused' ELSE 'followed by' END AS rel FROM f WHERE b IS NOT NULL")
def event_relations(spark, sf_dir):
    from pyspark.sql import Window

    events = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("subject"), "ts")
    after = F.lead("event_id").over(Window.partitionBy("subject").orderBy("ts", "event_id"))
    by_hand = events.select(F.col("event_id").alias("a"), after.alias("b"), F.lit("caused").alias("rel")).filter("b is not null and a % 100 = 7")
    return graph.event_relations(events, by_hand)


@query("graph_tie_list", f"WITH {_TIES}, w AS (SELECT a, b, layer, CASE WHEN a % 4 = 0 THEN 'buys' ELSE 'orders' END AS rel, (a * 7 + b * 3) % 101 AS weight FROM ties) SELECT a, b, rel, layer, weight, rank, FALSE AS last FROM (SELECT *, row_number() OVER (PARTITION BY layer, rel ORDER BY weight DESC, a, b)::INTEGER AS rank FROM w) WHERE rank <= 25")
def graph_tie_list(spark, sf_dir):
    t = ties(spark, sf_dir).withColumns({"rel": F.when(F.col("a") % 4 == 0, "buys").otherwise("orders"), "weight": (F.col("a") * 7 + F.col("b") * 3) % 101})
    return graph.tie_list(t).select("a", "b", "rel", "layer", "weight", "rank", "last")


@query("graph_rings", f"""WITH {_NEAR}, d AS (SELECT a AS node, count(*) AS d FROM near GROUP BY a), c AS (SELECT node FROM d ORDER BY d DESC, node LIMIT 1), s AS (SELECT a, b, layer FROM ties UNION SELECT b, a, layer FROM ties),
one AS (SELECT b AS node, count(DISTINCT layer)::DOUBLE AS score FROM s WHERE a = (SELECT node FROM c) AND a <> b GROUP BY b ORDER BY score DESC, node LIMIT 40),
two AS (SELECT near.b AS node, round(count(*) / (1 + 0.5 * log2(any_value(d))), 6) AS score FROM near JOIN one ON one.node = near.a JOIN d ON d.node = near.b WHERE near.b <> (SELECT node FROM c) AND near.b NOT IN (SELECT node FROM one) GROUP BY near.b ORDER BY score DESC, node LIMIT 48)
SELECT 1 AS ring, node, score FROM one UNION ALL SELECT 2, node, score FROM two""")
def graph_rings(spark, sf_dir):
    edges = ties(spark, sf_dir)
    return graph.rings(edges, graph.degrees(edges).orderBy(F.desc("degree"), "node").first()["node"])


@query("graph_communities")
def graph_communities(spark, sf_dir):
    held = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("basket"), F.col("l_suppkey").alias("item"), F.col("s_nationkey").cast("long").alias("nation")).distinct()
    pairs = held.select("basket", "nation", F.col("item").alias("a")).join(held.select("basket", "nation", F.col("item").alias("b")), ["basket", "nation"]).filter("a < b").groupBy("nation", "a", "b").agg(F.count("*").cast("double").alias("w"))
    return graph.communities(pairs, "nation")


@query("graph_assembly", "SELECT a, b, rel, layer, min_by(weight, f) AS weight, min(f)::INTEGER AS feeder FROM (SELECT c_custkey AS a, c_nationkey::BIGINT AS b, 'lives in' AS rel, 'register' AS layer, c_acctbal AS weight, 0 AS f FROM customer UNION ALL SELECT c_custkey, c_nationkey::BIGINT, 'lives in', 'register', 0, 1 FROM customer UNION ALL SELECT s_suppkey, s_nationkey::BIGINT, 'sells from', 'register', s_acctbal, 1 FROM supplier) WHERE a <> b GROUP BY a, b, rel, layer")
def graph_assembly(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    lives = [F.col("c_custkey").alias("a"), F.col("c_nationkey").cast("long").alias("b"), F.lit("lives in").alias("rel"), F.lit("register").alias("layer")]
    second = c.select(*lives, F.lit(0.0).alias("weight")).unionByName(s.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").cast("long").alias("b"), F.lit("sells from").alias("rel"), F.lit("register").alias("layer"), F.col("s_acctbal").alias("weight")))
    return graph.assemble([c.select(*lives, F.col("c_acctbal").alias("weight")), second])


def _gazetteer(spark) -> DataFrame:
    return spark.createDataFrame(_GAZ, "actor string, name string")


_GAZ = [("a1", "The"), ("a1", "Of the"), ("a2", "And"), ("a3", "In"), ("a4", "Der"), ("a5", "Les"), ("a6", "Que"), ("a2", "With the")]
_WORDS_SQL = r"""p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w, unnest(range(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')))) AS i, unnest(list_transform(regexp_split_to_array(text, '[\p{L}\p{N}_]+'), lambda g: length(g))) AS gap FROM documents),
o AS (SELECT doc_id, i, w, lead(w) OVER d AS nx, sum(gap + length(w)) OVER d - length(w) AS start FROM p WHERE w IS NOT NULL WINDOW d AS (PARTITION BY doc_id ORDER BY i))"""


def _hits_sql(rows) -> str:
    """The places of names of one word or two that don't overlap."""
    values = ", ".join(f"('{a}', '{n}')" for a, n in rows)
    return f"WITH n(actor, name) AS (VALUES {values}), {_WORDS_SQL}, h AS (SELECT doc_id, actor, name, start FROM o JOIN n ON name = w OR name = w || ' ' || nx)"


@query("name_mentions", _hits_sql([*_GAZ, ("a7", "Eriner"), ("a8", "Ofonrereer")]) + """, u AS (SELECT name, count_if(w = name) AS up, count_if(w = lower(name)) AS low FROM (SELECT DISTINCT name FROM n WHERE name NOT LIKE '% %' AND name NOT IN ('Eriner', 'Ofonrereer')) x JOIN o ON w = name OR w = lower(name) GROUP BY name)
SELECT doc_id, actor, count(*) AS hits, count(DISTINCT name) AS names FROM h WHERE name NOT IN (SELECT name FROM u WHERE low > up) AND name NOT IN (SELECT name FROM (SELECT name, (SELECT count(*) FROM o WHERE w = name) AS up, (SELECT count(*) FROM o WHERE w = lower(name)) AS low FROM (VALUES ('Eriner'), ('Ofonrereer')) v(name)) WHERE low > up) GROUP BY doc_id, actor HAVING bool_or(name <> 'In') OR count(DISTINCT name) > 1""")
def name_mentions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    # words of the tables that are mostly written with a capital, beside those that are ordinary words
    gazetteer = _gazetteer(spark).unionByName(spark.createDataFrame([("a7", "Eriner"), ("a8", "Ofonrereer")], "actor string, name string"))
    hits = names.match(docs, gazetteer)
    weak = spark.createDataFrame([("In",)], "name string")
    return names.mentions(hits, weak, names.capitalised_uses(docs, gazetteer))


@query("name_uses", r"SELECT name, count_if(w = name)::BIGINT AS upper, count_if(w = lower(name))::BIGINT AS lower FROM (SELECT unnest(['The', 'And', 'In', 'Der', 'Les', 'Que']) AS name) LEFT JOIN (SELECT unnest(regexp_split_to_array(text, '[^\p{L}\p{N}_]+')) AS w FROM documents) ON w = name OR w = lower(name) GROUP BY name")
def name_uses(spark, sf_dir):
    return names.capitalised_uses(read(spark, sf_dir, "documents"), _gazetteer(spark))


@query("name_pairs", _hits_sql(_GAZ) + ", d AS (SELECT DISTINCT x.doc_id, x.start, x.actor AS x, y.actor AS y FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.actor <> y.actor AND y.start BETWEEN x.start AND x.start + 600 AND (y.start > x.start OR y.actor > x.actor)) SELECT doc_id, least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM d GROUP BY 1, 2, 3")
def name_pairs(spark, sf_dir):
    return names.pairs(names.match(read(spark, sf_dir, "documents"), _gazetteer(spark)))


_GRAMS = "list_distinct(list_transform(range(1, length({x}) + 2), lambda i: substr('  ' || lower({x}) || ' ', i, 3)))"


@query("name_suggestions", f"""WITH g AS (SELECT n_name, n_nationkey AS docs, {_GRAMS.format(x='n_name')} AS x, {_GRAMS.format(x="'nation_1'")} AS y FROM nation), d AS (SELECT *, round(2 * len(list_intersect(x, y)) / (len(x) + len(y)), 6) AS dice FROM g),
p AS (SELECT *, CASE WHEN lower(n_name) = 'nation_1' THEN 100 WHEN starts_with(lower(n_name), 'nation_1') THEN 90 WHEN dice >= 0.6 THEN 40 + 40 * dice END::DOUBLE AS points FROM d)
SELECT n_name AS name, round(points + 4 * log10(1 + docs), 4) AS points FROM p WHERE points IS NOT NULL ORDER BY points DESC, name LIMIT 12""")
def name_suggestions(spark, sf_dir):
    return names.suggest(read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("docs")), "nation_1")


@query("name_unique_match", "SELECT s_suppkey AS left_id, c_custkey AS right_id FROM supplier JOIN customer ON lower(replace(s_name, 'Supplier', 'x')) = lower(replace(c_name, 'Customer', 'x'))")
def name_unique_match(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.replace("s_name", F.lit("Supplier"), F.lit("x")).alias("name"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.replace("c_name", F.lit("Customer"), F.lit("x")).alias("name"))
    return names.match_unique(s, c)
