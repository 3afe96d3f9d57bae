"""Overviews: dashboards, term trends, events on a time line, update plans, counts that each view shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_trend(counts: DataFrame, docs: DataFrame, alternatives: list[str], first: int, last: int) -> DataFrame:
    """year, docs, total, share: documents with any of the terms (`stem*` as a beginning), a row for every year."""
    from quillon.operators.scope import search_any

    hits = search_any(counts, [alternatives]).withColumn("hit", F.lit(1))
    per = docs.join(hits, "doc_id", "left").groupBy("year").agg(F.count("hit").alias("docs"), F.count("*").alias("total"))
    spine = docs.sparkSession.range(first, last + 1).withColumnRenamed("id", "year")
    joined = spine.join(per, "year", "left").na.fill(0)
    return joined.withColumn("share", F.when(F.col("total") > 0, F.round(F.col("docs") / F.col("total"), 4)).otherwise(F.lit(0.0)))


def dashboard(docs: DataFrame, today) -> DataFrame:
    """One row: total, agencies, countries, languages, undated, and what came in the last 7, 30 and 90 days."""
    day = F.lit(today).cast("date")
    added = {f"added_{n}": F.count_if(F.col("added").between(F.date_sub(day, n - 1), day)).alias(f"added_{n}") for n in (7, 30, 90)}
    return docs.agg(F.count("*").alias("total"), F.count_distinct("source").alias("agencies"), F.count_distinct("country").alias("countries"), F.count_distinct("lang").alias("langs"), F.count_if(F.col("year").isNull()).alias("undated"), *added.values())


def daily(docs: DataFrame, today, days: int = 30) -> DataFrame:
    """day, n: documents that came on each of the last `days` days, 0 included."""
    day = F.lit(today).cast("date")
    spine = docs.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(day, days - 1), day)).alias("day"))
    per = docs.groupBy(F.col("added").alias("day")).agg(F.count("*").alias("n"))
    return spine.join(per, "day", "left").na.fill(0, ["n"])


def year_split(docs: DataFrame) -> DataFrame:
    """year, publisher, n, and each kind's share of the year."""
    per = docs.filter("year is not null").groupBy("year", "publisher").agg(F.count("*").alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("year")), 4))


def newest(docs: DataFrame, k: int = 12) -> DataFrame:
    """The k documents that came last."""
    return docs.orderBy(F.desc("added"), F.desc("doc_id")).limit(k)


def markers(events: DataFrame, years: tuple[int, int], kinds: list[str], k: int = 3) -> DataFrame:
    """day, event_type, event_id, rank: the weightiest events of each kind and month as marks on a chart."""
    rows = events.filter(F.year("ts").between(*years) & F.col("event_type").isin(*kinds))
    w = Window.partitionBy("event_type", F.trunc("ts", "month")).orderBy(F.desc("value"), "event_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.to_date("ts").alias("day"), "event_type", "event_id", "rank")


def event_facets(events: DataFrame) -> DataFrame:
    """facet, value, n: how many events each choice of a facet would show."""
    kind = events.select(F.lit("kind").alias("facet"), F.col("event_type").alias("value"))
    month = events.select(F.lit("month").alias("facet"), F.date_format("ts", "yyyy-MM").alias("value"))
    return kind.unionByName(month).groupBy("facet", "value").agg(F.count("*").alias("n"))


def lanes(events: DataFrame, k: int = 5) -> DataFrame:
    """lane, day, event_id, place: a lane for each kind, with the k weightiest events of each day."""
    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy(F.desc("value"), "event_id")
    return events.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(F.col("event_type").alias("lane"), F.to_date("ts").alias("day"), "event_id", "place")


def event_reports(event_docs: DataFrame, docs: DataFrame) -> DataFrame:
    """event, reports, agencies: documents in the list's default scope that name an event."""
    return event_docs.join(docs.select("doc_id", "source"), "doc_id").groupBy("event").agg(F.count_distinct("doc_id").alias("reports"), F.count_distinct("source").alias("agencies"))


def actor_events(events: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """actor, event_id, role, rank: an actor's last k events, whatever its role in them. members has event_id, actor, role."""
    w = Window.partitionBy("actor").orderBy(F.desc("ts"), "event_id")
    one = members.groupBy("event_id", "actor").agg(F.min("role").alias("role"))
    return one.join(events.select("event_id", "ts"), "event_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("actor", "event_id", "role", "rank")


def month_totals(events: DataFrame, kinds: list[str]) -> DataFrame:
    """month, preliminary, and a total for each kind; the last month of the table is preliminary."""
    rows = events.withColumn("month", F.date_format("ts", "yyyy-MM"))
    sums = [F.round(F.sum(F.when(F.col("event_type") == k, F.col("value")).otherwise(0.0)), 2).alias(k) for k in kinds]
    per = rows.groupBy("month").agg(*sums)
    latest = rows.agg(F.max("month").alias("latest"))
    return per.join(F.broadcast(latest)).select("month", (F.col("month") == F.col("latest")).alias("preliminary"), *kinds)  # one row


def supersede(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of preliminary ones of the same key; final rows stay."""
    final = old.filter("not preliminary")
    return final.unionByName(new.join(final.select(key), key, "left_anti"))


def update_plan(pages: DataFrame, cutoff, seconds: float = 10.0) -> DataFrame:
    """source, pages, stale, seconds: a source is stale unless all its pages(source, crawled) are newer than the cutoff; a page
    that was never crawled is older than any."""
    old = F.col("crawled").isNull() | (F.col("crawled") < F.lit(cutoff).cast("timestamp"))
    per = pages.groupBy("source").agg(F.count("*").alias("pages"), F.count_if(old).alias("stale"))
    return per.filter("stale > 0").withColumn("seconds", F.col("pages") * seconds)


def seconds_per_page(crawls: DataFrame, last: int = 5, least: int = 20, otherwise: float = 10.0) -> DataFrame:
    """source, seconds: the mean of a source's last crawls(source, at, pages, seconds) if they read `least` pages."""
    w = Window.partitionBy("source").orderBy(F.desc("at"))
    recent = crawls.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= last).groupBy("source").agg(F.sum("pages").alias("p"), F.sum("seconds").alias("s"))
    return recent.select("source", F.when(F.col("p") >= least, F.round(F.col("s") / F.col("p"), 4)).otherwise(F.lit(otherwise)).alias("seconds"))


#: States of a page, worst first.
STATES = ["error", "blocked", "never", "skipped", "ok"]


def source_states(pages: DataFrame) -> DataFrame:
    """source, state: the worst state of a source's pages."""
    order = F.array(*[F.lit(s) for s in STATES])
    return pages.groupBy("source").agg(F.element_at(order, F.min(F.array_position(order, F.col("state"))).cast("int")).alias("state"))


def list_page(docs: DataFrame, all_files: DataFrame) -> DataFrame:
    """what, value, n: the list's total, its counts by type and language, and the other files of the same works."""
    total = docs.agg(F.count("*").alias("n")).select(F.lit("total").alias("what"), F.lit("").alias("value"), "n")
    kinds = docs.groupBy(F.coalesce("doc_type", F.lit("none")).alias("value")).agg(F.count("*").alias("n")).select(F.lit("type").alias("what"), "value", "n")
    langs = docs.groupBy(F.col("lang").alias("value")).agg(F.count("*").alias("n")).select(F.lit("lang").alias("what"), "value", "n")
    other = all_files.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("other files").alias("what"), F.lit("").alias("value"), "n")
    return total.unionByName(kinds).unionByName(langs).unionByName(other)


def figures(shown: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """key, shown, counted, ok: whether each number that a page shows is what its own link would list."""
    a, b = shown.select(key, F.col("n").alias("shown")), counted.select(key, F.col("n").alias("counted"))
    return a.join(b, key, "full_outer").withColumn("ok", F.col("shown").eqNullSafe(F.col("counted")))


def view_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """view, n: the rows that each view has."""
    out = None
    for name, df in parts.items():
        own = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("view"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def main_items(rows: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """group, item, n, rank: the k items that most rows of a group have."""
    per = rows.groupBy(group, item).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), item)
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def topic_points(topics: DataFrame, main: int = 3) -> DataFrame:
    """topic, points, docs: three points for a main topic, one for another."""
    return topics.groupBy("topic").agg(F.sum(F.when(F.col("rank") <= main, 3).otherwise(1)).alias("points"), F.count("*").alias("docs"))


def category_totals(topics: DataFrame, categories: DataFrame) -> DataFrame:
    """category, n, docs: topic counts summed to categories, and the documents behind them."""
    return topics.join(categories, "topic").groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def dated_evidence(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """claim_id, doc_id, place: where an asserted quote stands in its document, both folded to lower case and single spaces; place
    is null if the text doesn't have it."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return claims.join(texts, "doc_id").select("claim_id", "doc_id", plain(F.col("quote")).alias("q"), plain(F.col("text")).alias("t")).select("claim_id", "doc_id", F.expr("nullif(position(q in t), 0)").alias("place"))


def by_region(docs: DataFrame, regions: DataFrame, coalitions: DataFrame) -> DataFrame:
    """grouping, name, docs: documents by region and by coalition of their country; a country may be in several coalitions."""
    one = docs.join(regions, "country").groupBy("region").agg(F.count("*").alias("docs")).select(F.lit("region").alias("grouping"), F.col("region").alias("name"), "docs")
    many = docs.join(coalitions, "country").groupBy("coalition").agg(F.count_distinct("doc_id").alias("docs")).select(F.lit("coalition").alias("grouping"), F.col("coalition").alias("name"), "docs")
    return one.unionByName(many)


def found_stored(files: DataFrame) -> DataFrame:
    """country, found, stored: files that were found and those that are held."""
    return files.groupBy("country").agg(F.count("*").alias("found"), F.count_if(F.col("status") == "stored").alias("stored"))


def resolve_console(names: DataFrame, asked: str, weight: Column) -> DataFrame:
    """The row that a console word means: an exact name first, else the only name that begins with it; of several exact ones
    the weightiest. names has key, name."""
    q, n = asked.lower(), F.lower("name")
    exact = names.filter(n == q).withColumn("weight", weight).orderBy(F.desc("weight"), "key").limit(1).select("key", "name", F.lit(0).alias("how"))
    begins = names.filter(n.startswith(q) & (n != q))
    only = begins.groupBy().agg(F.min("key").alias("key"), F.min("name").alias("name"), F.count_distinct("key").alias("k")).filter("k = 1").select("key", "name", F.lit(1).alias("how"))
    return exact.unionByName(only).orderBy("how").limit(1).select("key", "name")
