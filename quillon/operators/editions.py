"""Series in detail: profile documents, topics and actors from one edition to the next, curation, what is to be collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAIN, RISE, CANDIDATES = 3, 2, 8


def doc_index(editions: DataFrame) -> DataFrame:
    """doc_id, series, year, lang: the edition that a document is, the first series if several claim it."""
    w = Window.partitionBy("doc_id").orderBy("series", "year", "lang")
    return editions.withColumn("r", F.row_number().over(w)).filter("r = 1").select("doc_id", "series", "year", "lang")


def profiles(editions: DataFrame, docs: DataFrame) -> DataFrame:
    """series, year, doc_id: the document that stands for an edition, English first, then the longest. docs has doc_id, chars."""
    best = F.max_by("doc_id", F.struct((F.col("lang") == "en"), "chars", -F.col("doc_id")))
    return editions.join(docs.select("doc_id", "chars"), "doc_id").groupBy("series", "year").agg(best.alias("doc_id"))


def topic_years(profile: DataFrame, topics: DataFrame) -> DataFrame:
    """series, year, topic, score, state: topics of an edition against those of the one before: in, out (score 0) or kept; the
    first edition's are in."""
    order = Window.partitionBy("series").orderBy("year")
    eds = profile.withColumns({"before": F.lag("year").over(order), "after": F.lead("year").over(order)})
    held = eds.join(topics.select("doc_id", "topic", "score"), "doc_id")
    per_topic = Window.partitionBy("series", "topic").orderBy("year")
    seen = held.withColumns({"prior": F.lag("year").over(per_topic), "next": F.lead("year").over(per_topic)})
    kept = F.col("before").isNotNull() & F.col("prior").eqNullSafe(F.col("before"))
    now = seen.select("series", "year", "topic", "score", F.when(kept, "kept").otherwise("in").alias("state"))
    gone = seen.filter("after is not null and not (next <=> after)").select("series", F.col("after").alias("year"), "topic", F.lit(0.0).alias("score"), F.lit("out").alias("state"))
    return now.unionByName(gone)


def new_actors(profile: DataFrame, named: DataFrame) -> DataFrame:
    """series, year, actor, hits, new: actors of an edition, and whether no earlier edition names them."""
    rows = profile.join(named.select("doc_id", "actor", "hits"), "doc_id")
    return rows.select("series", "year", "actor", "hits", (F.col("year") == F.min("year").over(Window.partitionBy("series", "actor"))).alias("new"))


def diff_topics(old: DataFrame, new: DataFrame) -> DataFrame:
    """topic, state, old, new of topics(topic, score) of two editions: new, gone, up or down (into or out of the three main
    ones), same."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "topic"))  # one edition's topics
        return df.select("topic", F.col("score").alias(name), (place <= MAIN).alias(f"main_{name}"))

    both = ranked(old, "old").join(ranked(new, "new"), "topic", "full_outer").na.fill(False, ["main_old", "main_new"])
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("main_new") & ~F.col("main_old"), "up").when(F.col("main_old") & ~F.col("main_new"), "down").otherwise("same")
    return both.select("topic", state.alias("state"), F.coalesce("old", F.lit(0.0)).alias("old"), F.coalesce("new", F.lit(0.0)).alias("new"))


def diff_actors(old: DataFrame, new: DataFrame, actors: DataFrame, own: str = "", rise: int = RISE) -> DataFrame:
    """actor, state, old, new of two editions' actors(actor, hits): added, dropped, or changed by `rise` hits or more. Countries
    and the agency's own name are left out."""
    who = actors.filter((F.col("kind") != "country") & (F.lower("label") != own.lower())).select("actor")
    a, b = old.select("actor", F.col("hits").alias("old")), new.select("actor", F.col("hits").alias("new"))
    both = a.join(b, "actor", "full_outer").join(who, "actor", "left_semi")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "dropped").when(F.abs(F.col("new") - F.col("old")) >= rise, "changed")
    return both.withColumn("state", state).filter("state is not null").na.fill(0, ["old", "new"]).select("actor", "state", "old", "new")


def curated(proposed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Proposals(source, key, ...) with status: confirmed, rejected or open, by the last of verdicts(source, key, verdict, at)."""
    last = verdicts.groupBy("source", "key").agg(F.max_by("verdict", "at").alias("verdict"))
    return proposed.join(last, ["source", "key"], "left").withColumn("status", F.coalesce("verdict", F.lit("open"))).drop("verdict")


def with_hand(cells: DataFrame, absent: DataFrame, attached: DataFrame) -> DataFrame:
    """Edition cells(series, year, lang, state) under a curator's word: attached files count as held, years that never appeared
    as absent."""
    held = attached.select("series", "year", "lang", F.lit("have").alias("hand")).unionByName(absent.select("series", "year", "lang", F.lit("absent").alias("hand")))
    hand = held.groupBy("series", "year", "lang").agg(F.max("hand").alias("hand"))
    return cells.join(hand, ["series", "year", "lang"], "left").withColumn("state", F.coalesce("hand", "state")).drop("hand")


def to_collect(cells: DataFrame, candidates: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """series, year, lang, state, candidates: missing editions and the first expected one of a language, with up to k files of
    that year and language that belong to no edition (candidates: series, year, lang, doc_id)."""
    first = F.row_number().over(Window.partitionBy("series", "lang", "state").orderBy("year"))
    wanted = cells.filter("state in ('missing', 'expected')").withColumn("r", first).filter("state = 'missing' or r = 1").drop("r")
    w = Window.partitionBy("series", "year", "lang").orderBy("doc_id")
    offered = candidates.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).groupBy("series", "year", "lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("candidates"))
    return wanted.join(offered, ["series", "year", "lang"], "left").na.fill("", ["candidates"])


def pattern_urls(patterns: DataFrame, first: int, last: int) -> DataFrame:
    """source, url, year, lang: addresses that a registry's patterns (source, pattern with {year} and {lang}, langs) give."""
    years = F.explode(F.sequence(F.lit(first), F.lit(last)))
    per = patterns.withColumn("year", years).withColumn("lang", F.explode("langs"))
    return per.select("source", F.replace(F.replace("pattern", F.lit("{year}"), F.col("year").cast("string")), F.lit("{lang}"), F.col("lang")).alias("url"), "year", "lang").dropDuplicates(["source", "url"])


def past_years(docs: DataFrame, today: int) -> DataFrame:
    """docs with years after the present one taken back: they are guessed again."""
    return docs.withColumn("year", F.when(F.col("year") <= today, F.col("year")))
