"""Queries for each join, aggregate, window, order and set operation, over the star schema and the event table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import relational
from quillon.plans.registry import query
from quillon.sources.library import read
from quillon.streaming import updates


@query("join_inner", "SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_inner(spark, sf_dir):
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("join_theta", "SELECT c_nationkey AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey AND (c_acctbal < 0 OR o_totalprice >= c_acctbal * 10) GROUP BY 1")
def join_theta(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    joined = o.join(c, (o.o_custkey == c.c_custkey) & ((c.c_acctbal < 0) | (o.o_totalprice >= c.c_acctbal * 10)))
    return joined.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))


_PAIRS = "(SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem)"


@query("join_self_pairs", f"SELECT x.s AS a, y.s AS b, count(*) AS n FROM {_PAIRS} x JOIN {_PAIRS} y ON x.o = y.o AND x.s < y.s GROUP BY ALL HAVING count(*) >= 2")
def join_self_pairs(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct()
    pairs = own.select("o", F.col("s").alias("a")).join(own.select("o", F.col("s").alias("b")), "o").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n >= 2")


@query("join_left", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def join_left(spark, sf_dir):
    done = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left").na.fill(0)


@query("join_semi", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 49)")
def join_semi(spark, sf_dir):
    big = read(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", "s_name").join(big, "s_suppkey", "left_semi")


@query("join_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 35)")
def join_anti(spark, sf_dir):
    back = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 35").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey").join(back, "p_partkey", "left_anti")


@query("join_scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def join_scalar_subquery(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    mean = o.groupBy("o_custkey").agg((1.5 * F.avg("o_totalprice")).alias("m"))
    return o.join(mean, "o_custkey").filter("o_totalprice > m").select("o_orderkey", "o_totalprice")


@query("join_unnest", r"SELECT e.event_type, k, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) e GROUP BY ALL")
def join_unnest(spark, sf_dir):
    keys = F.explode(F.json_object_keys("props")).alias("k")
    return read(spark, sf_dir, "events").select("event_type", keys).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("join_ordered_ids", "SELECT i.pos::INTEGER AS pos, c_custkey, c_name FROM (SELECT unnest([9, 3, 27, 81, 1]) AS id, unnest(range(5)) AS pos) i JOIN customer ON c_custkey = id")
def join_ordered_ids(spark, sf_dir):
    ids = spark.range(1).select(F.posexplode(F.array(*[F.lit(i).cast("long") for i in (9, 3, 27, 81, 1)])).alias("pos", "c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(F.broadcast(ids), "c_custkey").select("pos", "c_custkey", "c_name")


_MARKS = "(SELECT event_id, user_id, event_type, CAST(epoch(ts) AS BIGINT) AS sec FROM events)"


@query("join_band", f"""WITH m AS {_MARKS}, p AS (SELECT DISTINCT x.user_id, x.event_id, x.event_type AS a, y.event_type AS b FROM m x JOIN m y ON x.user_id = y.user_id AND x.event_type <> y.event_type AND y.sec BETWEEN x.sec AND x.sec + 3600 AND (y.sec > x.sec OR y.event_type > x.event_type))
SELECT user_id, least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM p GROUP BY ALL""")
def join_band(spark, sf_dir):
    marks = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", relational.nearest_second(F.col("ts")).alias("at"))
    return relational.band_pairs(marks, "user_id", "at", "event_type", 3600, mark="event_id")


@query("join_as_of", "SELECT e.event_id, (SELECT max(o.value) FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'purchase' AND o.ts = (SELECT max(i.ts) FROM events i WHERE i.user_id = e.user_id AND i.event_type = 'purchase' AND i.ts <= e.ts)) AS value FROM events e WHERE e.event_type = 'click'")
def join_as_of(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    asked = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    known = e.filter("event_type = 'purchase'").select("user_id", "ts", "value")
    return relational.as_of(asked, known, "user_id", "ts", "value").select("event_id", "value")


@query("join_full_outer", "WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT k, a.n AS before, b.n AS after, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'gone' WHEN b.n > a.n THEN 'up' WHEN b.n < a.n THEN 'down' ELSE 'same' END AS state FROM a FULL JOIN b USING (k)")
def join_full_outer(spark, sf_dir):
    per = lambda flag: read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"))
    return relational.compare(per("A"), per("R"), ["k"], "n")


@query("join_unique_names", "WITH u AS (SELECT n_nationkey, c_mktsegment, floor(c_acctbal / 1000)::BIGINT AS balance, min(c_custkey) AS c, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT n_nationkey, c_mktsegment, balance, c FROM u WHERE k = 1")
def join_unique_names(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return c.groupBy("n_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).alias("balance")).agg(F.min("c_custkey").alias("c"), F.count("*").alias("k")).filter("k = 1").drop("k")


@query("aggregate_measures", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def aggregate_measures(spark, sf_dir):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    shipped = read(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return shipped.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("charge"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


@query("aggregate_conditional", "SELECT o_custkey, count_if(o_orderstatus = 'F')::BIGINT AS done, count(DISTINCT CASE WHEN o_totalprice > 100000 THEN o_orderpriority END) AS kinds FROM orders GROUP BY 1 HAVING count(*) >= 5")
def aggregate_conditional(spark, sf_dir):
    per = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_distinct(F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority"))).alias("kinds"), F.count("*").alias("n"))
    return per.filter("n >= 5").drop("n")


@query("aggregate_lists", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def aggregate_lists(spark, sf_dir):
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("names"))


@query("aggregate_mode", "SELECT p_brand, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)) WHERE r = 1")
def aggregate_mode(spark, sf_dir):
    per = read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return relational.top_k(per, ["p_brand"], [F.desc("n"), F.col("p_type")], 1).drop("rank")


@query("aggregate_upper_median", "SELECT p_brand, list_sort(list(p_size))[len(list(p_size)) // 2 + 1] AS median FROM part GROUP BY 1")
def aggregate_upper_median(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(relational.upper_median("p_size").alias("median"))


@query("aggregate_dense_years", "SELECT y.year, coalesce(n, 0) AS n FROM (SELECT unnest(range(1990, 2006)) AS year) y LEFT JOIN (SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1) o USING (year)")
def aggregate_dense_years(spark, sf_dir):
    per = read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"))
    return relational.dense_years(per, 1990, 2005, "n")


@query("aggregate_pivot", "SELECT user_id, count_if(event_type = 'click')::BIGINT AS click, count_if(event_type = 'purchase')::BIGINT AS purchase, count_if(event_type = 'view')::BIGINT AS view FROM events GROUP BY 1")
def aggregate_pivot(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.count(F.lit(1))).na.fill(0)


@query("window_rank", "SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment)::INTEGER AS r, round((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1) / greatest(count(*) OVER (PARTITION BY c_nationkey) - 1, 1), 4) AS place FROM customer")
def window_rank(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("r", F.rank().over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment")))
    return relational.percent_position(c, ["c_nationkey"], [F.col("c_acctbal"), F.col("c_custkey")], "place").select("c_custkey", "c_nationkey", "r", "place")


@query("window_changes", "SELECT o_orderkey, prev, nxt FROM (SELECT o_orderkey, o_orderstatus, lag(o_orderstatus) OVER w AS prev, lead(o_orderkey) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE prev <> o_orderstatus")
def window_changes(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lag("o_orderstatus").over(w).alias("prev"), F.lead("o_orderkey").over(w).alias("nxt"))
    return o.filter("prev <> o_orderstatus").drop("o_orderstatus")


@query("window_first_last", "SELECT o_custkey, arg_min(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS first, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS last FROM orders GROUP BY 1")
def window_first_last(spark, sf_dir):
    at = F.struct("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first"), F.max_by("o_orderkey", at).alias("last"))


@query("window_densest", f"WITH m AS {_MARKS} SELECT user_id, max(n) AS n FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM m) GROUP BY 1")
def window_densest(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(relational.nearest_second(F.col("ts"))).rangeBetween(-86400, 0)
    return read(spark, sf_dir, "events").select("user_id", F.count("*").over(w).alias("n")).groupBy("user_id").agg(F.max("n").alias("n"))


@query("window_top_k", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey)::INTEGER AS rank FROM lineitem) WHERE rank <= 3")
def window_top_k(spark, sf_dir):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return relational.top_k(read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"), ["l_suppkey"], order, 3).drop("l_partkey")


@query("order_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40")
def order_page(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").offset(40).limit(20)


@query("order_even_sample", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE i = 0 OR floor(i * 4.0::DOUBLE / n) > floor((i - 1) * 4.0::DOUBLE / n)")
def order_even_sample(spark, sf_dir):
    w = Window.partitionBy("c_nationkey")
    placed = read(spark, sf_dir, "customer").select("c_custkey", (F.row_number().over(w.orderBy("c_custkey")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return placed.filter((F.col("i") == 0) | (F.floor(F.col("i") * 4.0 / F.col("n")) > F.floor((F.col("i") - 1) * 4.0 / F.col("n")))).select("c_custkey")


@query("sets_union", "SELECT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) WHERE k > 3")
def sets_union(spark, sf_dir):
    both = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).unionByName(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))
    return both.filter("k > 3").distinct()


@query("sets_algebra", "SELECT 'both' AS side, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'only', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def sets_algebra(spark, sf_dir):
    a, r = (read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == f).select("l_partkey") for f in ("A", "R"))
    return a.intersect(r).agg(F.lit("both").alias("side"), F.count("*").alias("n")).unionByName(a.subtract(r).agg(F.lit("only").alias("side"), F.count("*").alias("n")))


@query("register_upsert", "SELECT s_suppkey, s_name, true AS active FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, s_name, false FROM supplier WHERE s_suppkey % 3 = 0")
def register_upsert(spark, sf_dir):
    old = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit(True).alias("active"))
    return relational.upsert(old, old.filter("s_suppkey % 3 <> 0"), "s_suppkey")


_OURS = "(SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS p_brand, CASE WHEN p_partkey % 5 <> 0 THEN p_size ELSE 1 END AS p_size, p_partkey % 7 = 0 AS hand FROM part WHERE p_partkey % 3 <> 0)"


@query("merge_libraries", f"SELECT p_partkey, CASE WHEN coalesce(o.hand, false) THEN coalesce(o.p_brand, t.p_brand) ELSE coalesce(t.p_brand, o.p_brand) END AS p_brand, CASE WHEN coalesce(o.hand, false) THEN coalesce(o.p_size, t.p_size) ELSE coalesce(t.p_size, o.p_size) END AS p_size FROM {_OURS} o FULL JOIN (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 2 = 0) t USING (p_partkey)")
def merge_libraries(spark, sf_dir):
    return _merged(spark, sf_dir)[0]


@query("merge_conflicts", f"SELECT p_partkey, 'p_size' AS field, o.p_size::VARCHAR AS ours, t.p_size::VARCHAR AS theirs FROM {_OURS} o JOIN (SELECT p_partkey, p_size FROM part WHERE p_partkey % 2 = 0) t USING (p_partkey) WHERE o.p_size <> t.p_size")
def merge_conflicts(spark, sf_dir):
    return _merged(spark, sf_dir)[1]


def _merged(spark, sf_dir):
    k, part = F.col("p_partkey"), read(spark, sf_dir, "part")
    ours = part.filter("p_partkey % 3 <> 0").select(k, F.when(k % 4 != 0, F.col("p_brand")).alias("p_brand"), F.when(k % 5 != 0, F.col("p_size")).otherwise(1).alias("p_size"), (k % 7 == 0).alias("hand"))
    theirs = part.filter("p_partkey % 2 = 0").select("p_partkey", "p_brand", "p_size")
    return relational.merge(ours, theirs, "p_partkey", ["p_brand", "p_size"], by_hand="hand", prefer="theirs")


@query("updates_daily", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def updates_daily(spark, sf_dir):
    return updates.daily(read(spark, sf_dir, "events")).withColumn("value", F.round("value", 4))


@query("updates_sliding", "SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * k AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def updates_sliding(spark, sf_dir):
    return updates.sliding(read(spark, sf_dir, "events"))


@query("updates_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS end, count(*) AS n FROM s GROUP BY user_id, s""")
def updates_sessions(spark, sf_dir):
    return updates.sessions(read(spark, sf_dir, "events"))
