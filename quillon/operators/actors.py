"""Views of actors: lists, timelines, partners, connections, pairs; all over mentions and the pairs of one passage.

An actor's documents are those in scope from its founding year on. docs has doc_id, source, country, year; named has doc_id,
actor, hits, spans; pairs has doc_id, a, b, n; actors has actor, label, kind, iso, since.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.scope import after_founding, pairs_after_founding

WINDOW, SNIPPET = 600, 260


def named_docs(named: DataFrame, docs: DataFrame, actors: DataFrame) -> DataFrame:
    """named with the documents' columns, founding years respected."""
    return after_founding(named.join(docs, "doc_id"), actors)


def actor_list(named: DataFrame, docs: DataFrame, actors: DataFrame, kind: str | None = None, asked: str = "", least: int = 1, countries: bool = False) -> DataFrame:
    """actor, label, kind, docs, agencies, countries, first, last: the facet of actors, by kind or by a piece of the label."""
    who = actors.filter(F.col("kind") == kind) if kind else actors if countries else actors.filter("kind <> 'country'")
    if asked.strip():
        who = who.filter(F.lower("label").contains(asked.strip().lower()))
    rows = named_docs(named, docs, who)
    per = rows.groupBy("actor").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("source").alias("agencies"), F.count_distinct("country").alias("countries"), F.min("year").alias("first"), F.max("year").alias("last"))
    return per.filter(F.col("docs") >= least).join(who.select("actor", "label", "kind"), "actor")


def actor_years(named: DataFrame, docs: DataFrame, actors: DataFrame, actor: str) -> DataFrame:
    """year, docs, of, share: each year between an actor's first and last report, against all documents of the year."""
    own = named_docs(named.filter(F.col("actor") == actor), docs, actors).filter("year is not null")
    per = own.groupBy("year").agg(F.count_distinct("doc_id").alias("docs"))
    span = per.agg(F.min("year").alias("a"), F.max("year").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    of = docs.groupBy("year").agg(F.count("*").alias("of"))
    joined = span.join(per, "year", "left").join(of, "year", "left").na.fill(0, ["docs", "of"])
    return joined.withColumn("share", F.when(F.col("of") > 0, F.round(F.col("docs") / F.col("of"), 4)))


def actor_agencies(named: DataFrame, docs: DataFrame, actors: DataFrame, actor: str) -> DataFrame:
    """source, country, docs, first, last."""
    own = named_docs(named.filter(F.col("actor") == actor), docs, actors)
    return own.groupBy("source", "country").agg(F.count_distinct("doc_id").alias("docs"), F.min("year").alias("first"), F.max("year").alias("last"))


def before_founding(named: DataFrame, docs: DataFrame, actors: DataFrame) -> DataFrame:
    """doc_id, actor, year, since: mentions older than the actor, which the views leave out."""
    return named.join(docs, "doc_id").join(actors.select("actor", "since"), "actor").filter("year < since").select("doc_id", "actor", "year", "since")


def related(pairs: DataFrame, docs: DataFrame, actors: DataFrame, actor: str | None = None, k: int = 25) -> DataFrame:
    """actor, other, kind, docs, rank: actors and countries named in one passage with an actor, by documents; the k first of
    each of the two groups."""
    founded = pairs_after_founding(pairs, docs.select("doc_id", "year"), actors)
    both = founded.select(F.col("a").alias("actor"), F.col("b").alias("other"), "doc_id").unionByName(founded.select(F.col("b").alias("actor"), F.col("a").alias("other"), "doc_id"))
    both = both.filter(F.col("actor") == actor) if actor else both
    per = both.groupBy("actor", "other").agg(F.count_distinct("doc_id").alias("docs")).join(actors.select(F.col("actor").alias("other"), "kind"), "other")
    w = Window.partitionBy("actor", F.col("kind") == "country").orderBy(F.desc("docs"), "other")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("actor", "other", "kind", "docs", "rank")


#: Groups of relations, the first that a relation's words fit.
GROUPS = [("opponents", r"\b(opponent|rival|enemy|conflict)"), ("parts", r"\b(part of|subsidiary|owned|member)"), ("origin", r"\b(split|merged|follows|predecessor|successor)"), ("support", r"\b(sponsor|support|funded|ally)"), ("people", r"\b(leader|founder|commander|head)"), ("tools", r"\b(uses|tool|software|technique)"), ("places", r"\b(located|country|headquarters)")]


def connection_group(rel: Column) -> Column:
    """The group of a relation, "other" for the rest."""
    out = F.lit("other")
    for name, pattern in reversed(GROUPS):
        out = F.when(F.lower(rel).rlike(pattern), name).otherwise(out)
    return out


def connections(links: DataFrame, named: DataFrame, pairs: DataFrame, docs: DataFrame, actors: DataFrame) -> DataFrame:
    """actor, other, grouped, says, docs, together: stated links in both directions with the documents that name the other
    actor and those that name both in one passage."""
    out = links.select(F.col("a").alias("actor"), F.col("b").alias("other"), "rel", F.lit(True).alias("forward"))
    both = out.unionByName(links.select(F.col("b").alias("actor"), F.col("a").alias("other"), "rel", F.lit(False).alias("forward")))
    says = both.groupBy("actor", "other", connection_group(F.col("rel")).alias("grouped")).agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("forward"), F.col("rel")).otherwise(F.concat(F.lit("< "), F.col("rel"))))), " / ").alias("says"))
    count = named_docs(named, docs, actors).groupBy(F.col("actor").alias("other")).agg(F.count_distinct("doc_id").alias("docs"))
    founded = pairs_after_founding(pairs, docs.select("doc_id", "year"), actors).groupBy("a", "b").agg(F.count_distinct("doc_id").alias("together"))
    near = founded.select(F.col("a").alias("actor"), F.col("b").alias("other"), "together").unionByName(founded.select(F.col("b").alias("actor"), F.col("a").alias("other"), "together"))
    return says.join(count, "other", "left").join(near, ["actor", "other"], "left").na.fill(0, ["docs", "together"]).select("actor", "other", "grouped", "says", "docs", "together")


def closest_spans(pairs: DataFrame, named: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, a, b, n, first, second: for each pair of a passage the two marks that are closest to each other.

    For each mark of a, only the last mark of b before it and the first after it can be closest: found in b's sorted array, so
    two long lists are not multiplied.
    """
    spans = named.select("doc_id", F.col("actor").alias("a"), F.col("spans").alias("xs"))
    joined = pairs.join(spans, ["doc_id", "a"]).join(named.select("doc_id", F.col("actor").alias("b"), F.col("spans").alias("ys")), ["doc_id", "b"])
    marks = joined.select("doc_id", "a", "b", "n", F.explode("xs").alias("x"), "ys")
    # places of b's marks up to x: the sorted array is cut there
    upto = F.size(F.filter("ys", lambda y: y <= F.col("x")))
    near = F.filter(F.array(F.get("ys", upto - 1), F.get("ys", upto)), lambda y: y.isNotNull())
    best = marks.withColumn("y", F.explode(near)).groupBy("doc_id", "a", "b", "n").agg(F.min(F.struct(F.abs(F.col("x") - F.col("y")).alias("d"), F.col("x"), F.col("y"))).alias("m"))
    return best.filter(F.col("m.d") <= width).select("doc_id", "a", "b", "n", F.col("m.x").alias("first"), F.col("m.y").alias("second"))


def pair_documents(named: DataFrame, pairs: DataFrame, docs: DataFrame, actors: DataFrame) -> DataFrame:
    """a, b, passage, anywhere: documents in scope that name both actors in one passage, and those that name both at all."""
    founded = pairs_after_founding(pairs, docs.select("doc_id", "year"), actors).groupBy("a", "b").agg(F.count_distinct("doc_id").alias("passage"))
    rows = named_docs(named, docs, actors).select("doc_id", "actor")
    both = rows.withColumnRenamed("actor", "a").join(rows.withColumnRenamed("actor", "b"), "doc_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("anywhere"))
    return both.join(founded, ["a", "b"], "left").na.fill(0, ["passage"])


def nearby(named: DataFrame, linked: DataFrame, actors: DataFrame, width: int = WINDOW, k: int = 10) -> DataFrame:
    """doc_id, actor, other, rank: actors with a mark `width` characters or less from an actor's first mark; connected ones
    first, countries last."""
    first = named.select("doc_id", "actor", F.col("spans")[0].alias("at"))
    others = named.select("doc_id", F.col("actor").alias("other"), "spans").join(actors.select(F.col("actor").alias("other"), "label", "kind"), "other")
    both = linked.select(F.col("a").alias("actor"), F.col("b").alias("other")).unionByName(linked.select(F.col("b").alias("actor"), F.col("a").alias("other"))).distinct().withColumn("linked", F.lit(True))
    close = first.join(others, "doc_id").filter("actor <> other").filter(F.exists("spans", lambda s: F.abs(s - F.col("at")) <= width)).join(both, ["actor", "other"], "left")
    w = Window.partitionBy("doc_id", "actor").orderBy(F.col("linked").isNull(), F.col("kind") == "country", "label")
    return close.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("doc_id", "actor", "other", "rank")


def densest(named: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, actor, start, marks: the place from which most of an actor's marks lie within `width`; the earliest on ties.

    Marks are counted over a range of their own document, not joined."""
    marks = named.select("doc_id", "actor", F.explode("spans").alias("start"))
    ahead = Window.partitionBy("doc_id", "actor").orderBy("start").rangeBetween(0, width)
    counted = marks.withColumn("marks", F.count("*").over(ahead))
    return counted.groupBy("doc_id", "actor").agg(F.max(F.struct("marks", (-F.col("start")).alias("m"))).alias("x")).select("doc_id", "actor", (-F.col("x.m")).alias("start"), F.col("x.marks").alias("marks"))


def compare_agencies(named: DataFrame, docs: DataFrame, actors: DataFrame, k: int = 3) -> DataFrame:
    """actor, source, docs, first, last, doc_id, marks, rank: agencies side by side on an actor, each with its k densest
    passages."""
    rows = named_docs(named, docs, actors)
    per = rows.groupBy("actor", "source").agg(F.count_distinct("doc_id").alias("docs"), F.min("year").alias("first"), F.max("year").alias("last"))
    placed = densest(named).join(rows.select("doc_id", "actor", "source"), ["doc_id", "actor"])
    w = Window.partitionBy("actor", "source").orderBy(F.desc("marks"), "doc_id")
    top = placed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return per.join(top.select("actor", "source", "doc_id", "marks", "rank"), ["actor", "source"])


def first_last(named: DataFrame, docs: DataFrame, actors: DataFrame) -> DataFrame:
    """actor, source, docs, years, first_doc, last_doc: an agency's first and last dated report on an actor."""
    rows = named_docs(named, docs, actors).filter("year is not null")
    when = F.struct("year", "doc_id")
    return rows.groupBy("actor", "source").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("year").alias("years"), F.min(when).alias("a"), F.max(when).alias("b")).select("actor", "source", "docs", "years", F.col("a.doc_id").alias("first_doc"), F.col("b.doc_id").alias("last_doc"))


def country_years(named: DataFrame, docs: DataFrame, actors: DataFrame, actor: str, k: int = 25) -> DataFrame:
    """country, year, n: a cell for each of an actor's k countries and each year of its span, 0 where there is no report."""
    rows = named_docs(named.filter(F.col("actor") == actor), docs, actors).filter("year is not null")
    per = rows.groupBy("country", "year").agg(F.count_distinct("doc_id").alias("n"))
    top = per.groupBy("country").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "country").limit(k).select("country")
    span = per.agg(F.min("year").alias("a"), F.max("year").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    return top.join(F.broadcast(span)).join(per, ["country", "year"], "left").na.fill(0, ["n"])  # a span of years is a few dozen rows


def partner_states(pairs: DataFrame, docs: DataFrame, actors: DataFrame, last: int, recent: int = 3) -> DataFrame:
    """actor, other, first, last, docs, state: partners of a passage; new if first named in the last `recent` years, gone if
    not named in them."""
    founded = pairs_after_founding(pairs, docs.select("doc_id", "year"), actors).filter("year is not null")
    both = founded.select(F.col("a").alias("actor"), F.col("b").alias("other"), "doc_id", "year").unionByName(founded.select(F.col("b").alias("actor"), F.col("a").alias("other"), "doc_id", "year"))
    per = both.groupBy("actor", "other").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.count_distinct("doc_id").alias("docs"))
    return per.withColumn("state", F.when(F.col("first") > last - recent, "new").when(F.col("last") <= last - recent, "gone").otherwise("kept"))


def about_country(named: DataFrame, docs: DataFrame, actors: DataFrame, actor: str) -> DataFrame:
    """country, docs, of, share: of each reporting country's documents those that name a country; its own are left out."""
    own = actors.filter(F.col("actor") == actor).select("iso")
    num = named_docs(named.filter(F.col("actor") == actor), docs, actors).groupBy("country").agg(F.count_distinct("doc_id").alias("docs"))
    of = docs.groupBy("country").agg(F.count("*").alias("of"))
    return of.join(num, "country", "left").na.fill(0, ["docs"]).join(own, F.col("country") == F.col("iso"), "left_anti").withColumn("share", F.round(F.col("docs") / F.col("of"), 4))


def from_country(named: DataFrame, docs: DataFrame, actors: DataFrame, country: str) -> DataFrame:
    """actor, iso, docs, of, share: of a country's documents those that name each other country."""
    own = docs.filter(F.col("country") == country)
    of = own.agg(F.count("*").alias("of"))
    num = named_docs(named, own, actors.filter("kind = 'country'")).groupBy("actor").agg(F.count_distinct("doc_id").alias("docs"))
    joined = num.join(actors.select("actor", "iso"), "actor").filter(F.col("iso") != country).join(F.broadcast(of))  # one row
    return joined.withColumn("share", F.round(F.col("docs") / F.col("of"), 4)).select("actor", "iso", "docs", "of", "share")


def topic_actors(topics: DataFrame, named: DataFrame, docs: DataFrame, actors: DataFrame, k: int = 6, least: int = 3) -> DataFrame:
    """topic, actor, n, of, score, rank: the actors most characteristic of a topic, by n * n / of; n counts documents that have
    the topic among their three main ones and name the actor, of those that name it. Countries are left out."""
    rows = named_docs(named, docs, actors.filter("kind <> 'country'")).select("doc_id", "actor").distinct()
    of = rows.groupBy("actor").agg(F.count("*").alias("of"))
    main = topics.filter("rank <= 3").select("doc_id", "topic")
    per = main.join(rows, "doc_id").groupBy("topic", "actor").agg(F.count("*").alias("n")).filter(F.col("n") >= least).join(of, "actor")
    per = per.withColumn("score", F.round(F.col("n") * F.col("n") / F.col("of"), 6))
    w = Window.partitionBy("topic").orderBy(F.desc("score"), "actor")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("topic", "actor", "n", "of", "score", "rank")


def cluster_summary(members: DataFrame, pairs: DataFrame, docs: DataFrame, actors: DataFrame, topics: DataFrame) -> DataFrame:
    """cluster, actors, docs, agencies, first, last, topics of members(cluster, actor): over the documents that name two of a
    cluster's actors in one passage, with the main topics that two or more of them have."""
    founded = pairs_after_founding(pairs, docs.select("doc_id", "year", "source"), actors)
    inside = founded.join(members.select("cluster", F.col("actor").alias("a")), "a").join(members.select(F.col("cluster").alias("c2"), F.col("actor").alias("b")), "b").filter("cluster = c2")
    own = inside.select("cluster", "doc_id", "year", "source").distinct()
    per = own.groupBy("cluster").agg(F.count("*").alias("docs"), F.count_distinct("source").alias("agencies"), F.min("year").alias("first"), F.max("year").alias("last"))
    main = own.join(topics.filter("rank <= 3").select("doc_id", "topic"), "doc_id").groupBy("cluster", "topic").agg(F.count("*").alias("n")).filter("n >= 2")
    named = main.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "topic"))), lambda x: x["topic"]), ",").alias("topics"))
    size = members.groupBy("cluster").agg(F.count("*").alias("actors"))
    return size.join(per, "cluster").join(named, "cluster", "left").na.fill("", ["topics"])


def dated_records(parts: dict[str, DataFrame]) -> DataFrame:
    """actor, date, what, note of several kinds of records(actor, date, note), in one order: partial dates are filled up with
    zeros, a year that is only the latest possible one sorts last in it."""
    out = None
    for what, df in parts.items():
        date = F.col("date")
        full = F.when(date.startswith("<"), F.concat(F.substring(date, 2, 4), F.lit("-99-99"))).otherwise(F.substring(F.concat(date, F.lit("-00-00")), 1, 10))
        own = df.select("actor", full.alias("date"), F.lit(what).alias("what"), "note")
        out = own if out is None else out.unionByName(own)
    return out
