"""Analyses of records: codes and their lags, panels of ratings, citations, agencies side by side, aliases, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_histogram(mentions: DataFrame, top: int = 10) -> DataFrame:
    """lag, n of mentions(doc_id, code, year, code_year): years between a code and the report, -1 for earlier, `top` and more
    together."""
    lag = F.least(F.greatest(F.col("year") - F.col("code_year"), F.lit(-1)), F.lit(top))
    return mentions.filter("year is not null").groupBy(lag.cast("int").alias("lag")).agg(F.count_distinct("doc_id", "code").alias("n"))


def code_overview(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """code, docs, sources, first, last, listed of mentions(doc_id, source, code, year); known(code) is a catalogue."""
    per = mentions.groupBy("code").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("source").alias("sources"), F.min("year").alias("first"), F.max("year").alias("last"))
    return per.join(known.select("code", F.lit(True).alias("listed")), "code", "left").na.fill(False, ["listed"])


def grid(mentions: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """group, code, docs: the k codes of each group in most documents. groups(code, grouped) may name a code in several."""
    per = mentions.join(groups, "code").groupBy("grouped", "code").agg(F.count_distinct("doc_id").alias("docs"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("grouped").orderBy(F.desc("docs"), "code"))).filter(F.col("rank") <= k)


def panel_ranks(panel: DataFrame) -> DataFrame:
    """measure, unit, value, rank, of: each unit's latest value and its place among all; ties share the first place."""
    latest = panel.groupBy("measure", "unit").agg(F.max_by("value", "year").alias("value"))
    w = Window.partitionBy("measure")
    return latest.withColumns({"rank": F.rank().over(w.orderBy(F.desc("value"))), "of": F.count("*").over(w)})


def change_points(panel: DataFrame) -> DataFrame:
    """measure, unit, year, before, value where a value differs from the one before."""
    before = F.lag("value").over(Window.partitionBy("measure", "unit").orderBy("year"))
    return panel.withColumn("before", before).filter("before is not null and before <> value").select("measure", "unit", "year", "before", "value")


def steps(announced: DataFrame) -> DataFrame:
    """system, since, until, level: a level holds until the next announcement."""
    return announced.select("system", F.col("at").alias("since"), F.lead("at").over(Window.partitionBy("system").orderBy("at")).alias("until"), "level")


def citation_matrix(links: DataFrame, n: int = 30) -> DataFrame:
    """citing, cited, links, share among the n hosts that cite or are cited most; share of the citing host's links."""
    ends = links.select(F.col("citing").alias("h"), "links").unionByName(links.select(F.col("cited").alias("h"), "links"))
    top = ends.groupBy("h").agg(F.sum("links").alias("t")).orderBy(F.desc("t"), "h").limit(n).select("h")
    inside = links.join(F.broadcast(top.withColumnRenamed("h", "citing")), "citing", "left_semi").join(F.broadcast(top.withColumnRenamed("h", "cited")), "cited", "left_semi")
    return inside.withColumn("share", F.round(F.col("links") / F.sum("links").over(Window.partitionBy("citing")), 4)).select("citing", "cited", "links", "share")


def longest_host(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """url_id, source: the source whose home host is the longest parent of a url's host, down to two labels. A host probes
    its parents, an equi-join; a home that several sources share resolves nothing."""
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    probes = urls.select("url_id", F.posexplode(parents).alias("p", "home"))
    own = hosts.groupBy("home").agg(F.min("source").alias("source"), F.count_distinct("source").alias("k"))
    return probes.join(own, "home").groupBy("url_id").agg(F.min_by(F.struct("source", "k"), "p").alias("x")).filter("x.k = 1").select("url_id", "x.source")


def alias_vote(written: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, actor: written(id, alias) resolved by votes over aliases(alias, actor): the only candidate, or one with two votes
    and twice the next one's."""
    votes = written.join(aliases, "alias").groupBy("id", "actor").agg(F.count_distinct("alias").alias("v"))
    w = Window.partitionBy("id").orderBy(F.desc("v"), "actor")
    ranked = votes.withColumns({"r": F.row_number().over(w), "next": F.lead("v").over(w)})
    return ranked.filter("r = 1 and (next is null or (v >= 2 and v >= 2 * next))").select("id", "actor")


def worst_level(checks: DataFrame, order: list[str]) -> DataFrame:
    """subject, level: the worst of its checks, order from worst to best."""
    place = F.coalesce(*[F.when(F.col("status") == s, F.lit(i)) for i, s in enumerate(order)])
    names = F.array(*[F.lit(s) for s in order])
    return checks.withColumn("p", place).filter("p is not null").groupBy("subject").agg(F.element_at(names, F.min("p") + 1).alias("level"))


def timeline(rows: DataFrame, group: str, recent: int) -> DataFrame:
    """group, partner, first, last, docs, state: partners seen only in the last three years are new, those not seen in them
    are gone."""
    per = rows.groupBy(group, "partner").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.count_distinct("doc_id").alias("docs"))
    return per.withColumn("state", F.when(F.col("first") > recent - 3, "new").when(F.col("last") <= recent - 3, "gone").otherwise("kept"))


def jump_points(label: Column, asked: str, weight: Column, alias: Column) -> Column:
    """Exact 100, beginning 80, beginning of a word 60, inside 40; aliases less, weighty ones more, long ones less."""
    low, q = F.lower(label), asked.lower()
    base = F.when(low == q, 100).when(low.startswith(q), 80).when(low.contains(f" {q}"), 60).when(low.contains(q), 40)
    return base - F.when(alias, 10).otherwise(0) + F.least(weight, F.lit(9)) - F.length(label) / 100


def unit_blocks(pages: DataFrame, size: int = 25) -> DataFrame:
    """book, unit, first, last, text: blocks of `size` pages where a book has no chapters; bounded by that size."""
    unit = F.floor((F.col("page") - 1) / size).cast("int")
    per = pages.groupBy("book", unit.alias("unit")).agg(F.min("page").alias("first"), F.max("page").alias("last"), F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    return per.select("book", "unit", "first", "last", F.array_join(F.col("p.text"), " ").alias("text"))


def statements(sentences: DataFrame, pattern: str) -> DataFrame:
    """unit, place, sentence, year: sentences that match and name a year, with the first one."""
    year = F.regexp_extract("sentence", r"\b((?:19|20)[0-9]{2})\b", 1)
    return sentences.filter(F.col("sentence").rlike(pattern) & (year != "")).select("unit", "place", "sentence", year.cast("int").alias("year"))


def freshness(ours: DataFrame, theirs: DataFrame, key: str, at: str) -> DataFrame:
    """only_ours, only_theirs, ours_newer, theirs_newer, verdict of two libraries."""
    a, b = ours.select(key, F.col(at).alias("x")), theirs.select(key, F.col(at).alias("y"))
    n = a.join(b, key, "full_outer").agg(F.count_if(F.col("y").isNull()).alias("only_ours"), F.count_if(F.col("x").isNull()).alias("only_theirs"), F.count_if(F.col("x") > F.col("y")).alias("ours_newer"), F.count_if(F.col("y") > F.col("x")).alias("theirs_newer"))
    mine, yours = F.col("only_ours") + F.col("ours_newer"), F.col("only_theirs") + F.col("theirs_newer")
    verdict = F.when((mine == 0) & (yours == 0), "same").when(mine == 0, "older").when(yours == 0, "newer").when((F.col("ours_newer") == 0) & (F.col("theirs_newer") == 0), "complements").otherwise("mixed")
    return n.withColumn("verdict", verdict)
