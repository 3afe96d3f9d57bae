"""Works (files that are one publication), series and their editions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import series_key
from quillon.operators.graph import components

ENGLISH, MIN_YEARS, ALIKE = 1.3, 3, 0.5


def group_works(files: DataFrame, keys: list[list[str]], checkpoint=None) -> DataFrame:
    """id, work_id: files that share all columns of one of the key sets, closed over; the work's id is that of the longest
    file, English ones weighing more, the smallest id on ties. Each key set gives a star, not all pairs."""
    edges = None
    for key in keys:
        present = files.filter(F.forall(F.array(*[F.col(k).isNotNull() for k in key]), lambda x: x))
        first = present.groupBy(*key).agg(F.min("id").alias("a"))
        star = present.join(first, key).select("a", F.col("id").alias("b")).filter("a <> b")
        edges = star if edges is None else edges.unionByName(star)
    member = components(edges, checkpoint).select(F.col("node").alias("id"), "component")
    weight = F.col("chars") * F.when(F.col("lang") == "en", ENGLISH).otherwise(1.0)
    placed = files.join(member, "id", "left").withColumn("component", F.coalesce("component", "id"))
    best = placed.groupBy("component").agg(F.max_by("id", F.struct(weight, -F.col("id"))).alias("work_id"))
    return placed.join(best, "component").select("id", "work_id")


def propose_series(files: DataFrame, least: int = MIN_YEARS) -> DataFrame:
    """source, key, langs, since, until, years: titles equal but for the year that recur in `least` years; languages of one
    publisher merge when the years they share are half of all."""
    per = files.filter("year is not null").select("source", "lang", series_key(F.col("title")).alias("key"), "year").filter("key <> ''").distinct()
    own = Window.partitionBy("source", "lang", "key")
    rows = per.withColumn("n", F.count("*").over(own)).filter(F.col("n") >= least)
    # shared years are counted over an equi-join on publisher and year; titles that share none can't merge
    other = rows.select("source", "year", F.col("lang").alias("l"), F.col("key").alias("k"), F.col("n").alias("m"))
    shared = rows.join(other, ["source", "year"]).groupBy("source", "lang", "key", "n", "l", "k", "m").agg(F.count("*").alias("s"))
    alike = shared.filter((F.col("s") / (F.col("n") + F.col("m") - F.col("s")) >= ALIKE) & (F.struct(-F.col("m"), F.col("l"), F.col("k")) <= F.struct(-F.col("n"), F.col("lang"), F.col("key"))))
    leader = alike.groupBy("source", "lang", "key").agg(F.min(F.struct((-F.col("m")).alias("m"), "l", "k")).alias("to"))
    merged = rows.join(leader, ["source", "lang", "key"]).groupBy("source", F.col("to.k").alias("key"), F.col("to.l").alias("first")).agg(F.sort_array(F.collect_set("lang")).alias("langs"), F.min("year").alias("since"), F.max("year").alias("until"), F.count_distinct("year").cast("int").alias("years"))
    return merged.select("source", "key", F.array_join("langs", ",").alias("langs"), "since", "until", "years")


def editions(series: DataFrame, files: DataFrame, today: int) -> DataFrame:
    """series, year, lang, state: have, listed, expected (the current year) or missing, for each year since the first and
    each language. series has series, since, langs; files has series, year, lang, stored."""
    cells = series.select("series", F.explode(F.sequence("since", F.lit(today))).alias("year"), "langs").select("series", "year", F.explode("langs").alias("lang"))
    held = files.groupBy("series", "year", "lang").agg(F.max("stored").alias("stored"))
    state = F.when(F.col("stored"), "have").when(~F.col("stored"), "listed").when(F.col("year") >= today, "expected").otherwise("missing")
    return cells.join(held, ["series", "year", "lang"], "left").select("series", "year", "lang", state.alias("state"))


def first_seen(rows: DataFrame, group: str, item: str, year: str) -> DataFrame:
    """group, year, item, new: whether an item appears in its group for the first time."""
    return rows.select(group, year, item).distinct().withColumn("new", F.col(year) == F.min(year).over(Window.partitionBy(group, item)))
