"""Trends, emphasis, associations of publishers, updates: each number counts documents of the listed scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.relational import dense_years


def topic_trend(docs: DataFrame, tagged: DataFrame, topic: str, first: int, last: int) -> DataFrame:
    """year, docs, total, share, sources, source_share of the documents with a topic, a row for each year."""
    dated = docs.filter(F.col("year").between(first, last)).select("doc_id", F.col("year").cast("long").alias("year"), "source")
    total = dense_years(dated.groupBy("year").agg(F.count("*").alias("total"), F.count_distinct("source").alias("all_sources")), first, last, "total")
    own = dated.join(tagged.filter(F.col("topic") == topic).select("doc_id").distinct(), "doc_id", "left_semi").groupBy("year").agg(F.count("*").alias("docs"), F.count_distinct("source").alias("sources"))
    both = total.join(own, "year", "left").na.fill(0, ["docs", "sources", "all_sources"])
    return both.select("year", "docs", "total", F.round(F.when(F.col("total") > 0, F.col("docs") / F.col("total")).otherwise(0.0), 4).alias("share"), "sources", F.round(F.when(F.col("all_sources") > 0, F.col("sources") / F.col("all_sources")).otherwise(0.0), 4).alias("source_share"))


def rising(docs: DataFrame, tagged: DataFrame, year: int) -> DataFrame:
    """topic, recent, before, points: share in the two years before `year` less that in the three before those, in
    percentage points."""
    period = F.when(F.col("year").between(year - 2, year - 1), "r").when(F.col("year").between(year - 5, year - 3), "b")
    dated = docs.withColumn("period", period).filter("period is not null")
    total = dated.agg(F.count_if(F.col("period") == "r").alias("tr"), F.count_if(F.col("period") == "b").alias("tb"))
    per = dated.join(tagged.select("doc_id", "topic").distinct(), "doc_id").groupBy("topic").agg(F.count_if(F.col("period") == "r").alias("recent"), F.count_if(F.col("period") == "b").alias("before"))
    share = lambda n, t: F.when(F.col(t) > 0, F.col(n) / F.col(t)).otherwise(0.0)
    return per.join(F.broadcast(total)).select("topic", "recent", "before", F.round(100 * (share("recent", "tr") - share("before", "tb")), 1).alias("points"))


def emphasis(docs: DataFrame, tagged: DataFrame, by: str, least: int = 5) -> DataFrame:
    """by, topic, n, share, lift: a row's share of documents with a topic against that of all rows; rows with `least`
    documents."""
    total = docs.groupBy(by).agg(F.count("*").alias("rows")).filter(F.col("rows") >= least)
    every = docs.agg(F.count("*").alias("all_rows"))
    topical = docs.select("doc_id", by).join(tagged.select("doc_id", "topic").distinct(), "doc_id")
    overall = topical.groupBy("topic").agg(F.count("*").alias("all_n"))
    cells = topical.groupBy(by, "topic").agg(F.count("*").alias("n")).join(total, by).join(overall, "topic").join(F.broadcast(every))
    share = F.col("n") / F.col("rows")
    return cells.select(by, "topic", "n", F.round(share, 4).alias("share"), F.round(share / (F.col("all_n") / F.col("all_rows")), 4).alias("lift"))


def briefing(docs: DataFrame, tagged: DataFrame, chosen, least: int = 3) -> DataFrame:
    """topic, n, lift, weight: what a set of documents stands out by: lift above 1, ranked by n * log2(lift)."""
    inside = docs.filter(chosen)
    n_set, n_all = inside.agg(F.count("*").alias("ns")), docs.agg(F.count("*").alias("na"))
    topics = tagged.select("doc_id", "topic").distinct()
    own = inside.join(topics, "doc_id").groupBy("topic").agg(F.count("*").alias("n"))
    whole = docs.join(topics, "doc_id").groupBy("topic").agg(F.count("*").alias("n_all"))
    lift = (F.col("n") / F.col("ns")) / (F.col("n_all") / F.col("na"))
    found = own.join(whole, "topic").join(F.broadcast(n_set)).join(F.broadcast(n_all)).withColumn("lift", lift).filter((F.col("lift") > 1) & (F.col("n") >= least))
    return found.select("topic", "n", F.round("lift", 4).alias("lift"), F.round(F.col("n") * F.log2("lift"), 4).alias("weight"))


def excluded(docs: DataFrame) -> DataFrame:
    """How many documents each rule leaves out of the series: undated, before 2000, not reports, by other publishers."""
    return docs.agg(F.count("*").alias("docs"), F.count_if(F.col("year").isNull()).alias("undated"), F.count_if(F.col("year") < 2000).alias("early"), F.count_if(F.col("doc_type") == "notice").alias("not_reports"), F.count_if(F.col("publisher") == "think_tank").alias("think_tanks"), F.count_if(F.col("publisher") == "commercial").alias("commercial"))


def update_jumps(docs: DataFrame, tagged: DataFrame, day: str, least: int = 3) -> DataFrame:
    """topic, new, before, jump: topics whose share among a day's arrivals exceeds their share before, in points."""
    d = F.lit(day).cast("date")
    seen = docs.filter(F.col("added") <= d).withColumn("fresh", F.col("added") == d)
    total = seen.agg(F.count_if("fresh").alias("tn"), F.count_if(~F.col("fresh")).alias("tb"))
    per = seen.join(tagged.select("doc_id", "topic").distinct(), "doc_id").groupBy("topic").agg(F.count_if("fresh").alias("new"), F.count_if(~F.col("fresh")).alias("before"))
    now, then = F.col("new") / F.col("tn"), F.when(F.col("tb") > 0, F.col("before") / F.col("tb")).otherwise(0.0)
    return per.join(F.broadcast(total)).filter((F.col("new") >= least) & (now > then)).select("topic", "new", "before", F.round(100 * (now - then), 1).alias("jump"))


def watch_counts(docs: DataFrame, queries: dict[str, F.Column]) -> DataFrame:
    """query, added, n: arrivals of each saved query by day, in one pass."""
    hits = F.explode(F.array_compact(F.array(*[F.when(q, F.lit(name)) for name, q in queries.items()]))).alias("query")
    return docs.select("added", hits).groupBy("query", "added").agg(F.count("*").alias("n"))


def coverage(docs: DataFrame, sources: DataFrame, newest: int, stale: int = 3) -> DataFrame:
    """country, publisher, docs, last, state of each combination that has a publisher: covered, stale, empty or closed."""
    per = docs.groupBy("country", "publisher").agg(F.count("*").alias("docs"), F.max("year").alias("last"))
    grid = sources.groupBy("country", "publisher").agg(F.max("active").alias("open"))
    state = F.when(~F.col("open"), "closed").when(F.col("docs").isNull(), "empty").when(F.col("last") < newest - stale, "stale").otherwise("covered")
    return grid.join(per, ["country", "publisher"], "left").select("country", "publisher", F.coalesce("docs", F.lit(0)).alias("docs"), "last", state.alias("state"))
