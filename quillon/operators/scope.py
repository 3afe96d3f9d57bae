"""Facets over records: semi-joins that narrow the documents by editions, events, actors, codes, techniques and links."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Facets:
    """What to narrow by; every field that is set is one more condition."""

    all_files: bool = False
    any_type: bool = False
    indexed: bool = False
    event: int | None = None
    actor: str | None = None
    series: str | None = None
    cluster: tuple[str, ...] = ()
    cve: str | None = None
    cve_near: str | None = None
    technique: str | None = None
    cite: str | None = None
    official: bool = False
    source: str | None = None


def canonical(docs: DataFrame) -> DataFrame:
    """One file of each work: the work's own one, or a file without a work."""
    return docs.filter("work_id is null or work_id = doc_id")


def after_founding(rows: DataFrame, actors: DataFrame, key: str = "actor") -> DataFrame:
    """rows (with year) of actors, without those from before an actor's founding year; unknown years count."""
    founded = actors.select(F.col("actor").alias(key), F.col("since").alias(f"since_{key}"))
    return rows.join(founded, key).filter(f"since_{key} is null or year is null or year >= since_{key}").drop(f"since_{key}")


def pairs_after_founding(pairs: DataFrame, docs: DataFrame, actors: DataFrame) -> DataFrame:
    """pairs(doc_id, a, b) with the documents' columns, where both actors existed."""
    return after_founding(after_founding(pairs.join(docs, "doc_id"), actors, "a"), actors, "b")


def age_bucket(year: Column, code_year: Column, top: int = 10) -> Column:
    """Years from a code to the report: -1 if the code is younger, `top` and more together."""
    return F.least(F.greatest(year - code_year, F.lit(-1)), F.lit(top))


def known_bucket(year: Column, known_year: Column) -> Column:
    """Whether a report came before, in the same year as or after a code's listing."""
    return F.when(year < known_year, "before").when(year == known_year, "same").when(year > known_year, "after")


def near_marks(codes: DataFrame, marks: DataFrame, width: int = 600) -> DataFrame:
    """doc_id, code, actor of codes and marks (each with doc_id, start) at most `width` characters apart.

    A mark probes its own cell of `width` characters and the two beside it, an equi-join, whatever the document's length.
    """
    cell = F.floor(F.col("start") / width)
    probes = codes.select("doc_id", "code", F.col("start").alias("at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    placed = marks.select("doc_id", "actor", F.col("start").alias("to"), cell.alias("cell"))
    return probes.join(placed, ["doc_id", "cell"]).filter(F.abs(F.col("at") - F.col("to")) <= width).select("doc_id", "code", "actor").distinct()


_CITE = re.compile(r"^(doc|by|src|host|stype|agency|ccountry):(.+)$")


def parse_cite(value: str) -> tuple[str, str] | None:
    """The kind and the value of a citation facet, None if it isn't one."""
    m = _CITE.match(value or "")
    if not m or (m[1] in ("doc", "by") and not m[2].isdigit()):
        return None
    return m[1], m[2]


def citing(citations: DataFrame, docs: DataFrame, sources: DataFrame, kind: str, value: str) -> DataFrame:
    """doc_id of the documents that a citation facet names. docs has doc_id and source; sources source, country, publisher.

    doc: those that cite a document; by: those that it cites; src: those that link to a source; host: to an outside host;
    stype, agency, ccountry: to another source of a type, that source or a country (agency and ccountry: any other one).
    """
    if kind == "doc":
        return citations.filter(F.col("to_doc") == int(value)).select("doc_id").distinct()
    if kind == "by":
        return citations.filter((F.col("doc_id") == int(value)) & F.col("to_doc").isNotNull()).select(F.col("to_doc").alias("doc_id")).distinct()
    if kind == "src":
        return citations.filter(F.col("to_source") == value).select("doc_id").distinct()
    if kind == "host":
        return citations.filter((F.col("host") == value.lower()) & F.col("to_doc").isNull() & F.col("to_source").isNull()).select("doc_id").distinct()
    own = docs.select("doc_id", F.col("source").alias("own"))
    other = citations.filter("to_source is not null").join(own, "doc_id").filter("own <> to_source").join(sources.withColumnRenamed("source", "to_source"), "to_source")
    column = {"stype": "publisher", "agency": "to_source", "ccountry": "country"}[kind]
    return (other if value == "any" and kind != "stype" else other.filter(F.col(column) == value)).select("doc_id").distinct()


def narrow(docs: DataFrame, f: Facets, tables: dict[str, DataFrame]) -> DataFrame:
    """docs under f. tables holds what the fields need: actors, doc_actors, pairs, editions, event_docs, codes, near_codes,
    techniques, citations, sources. Each facet is a semi-join or a comparison, so the plan has one for each set field.
    """

    def among(found: DataFrame) -> None:
        nonlocal docs
        docs = docs.join(found.select("doc_id"), "doc_id", "left_semi")

    if not (f.all_files or f.series):
        docs = canonical(docs)
    if f.indexed:
        docs = docs.filter("indexed")
    if f.official:
        docs = docs.filter("publisher = 'official'")
    if f.source:
        docs = docs.filter(F.col("source") == f.source)
    if f.event is not None:
        among(tables["event_docs"].filter(F.col("event") == f.event))
    if f.actor:
        named = tables["doc_actors"].filter(F.col("actor") == f.actor).join(docs.select("doc_id", "year"), "doc_id")
        among(after_founding(named, tables["actors"]))
    if f.series:
        among(tables["editions"].filter(F.col("series") == f.series))
    if f.cluster:
        inside = tables["pairs"].filter(F.col("a").isin(*f.cluster) & F.col("b").isin(*f.cluster))
        among(pairs_after_founding(inside, docs.select("doc_id", "year"), tables["actors"]))
    if f.cve == "known":
        among(tables["codes"].filter("known_year is not null"))
    elif f.cve and f.cve.startswith("age:"):
        dated = tables["codes"].join(docs.select("doc_id", "year"), "doc_id").filter("year is not null")
        among(dated.filter(age_bucket(F.col("year"), F.col("code_year")) == int(f.cve[4:])))
    elif f.cve and f.cve.startswith("known:"):
        dated = tables["codes"].join(docs.select("doc_id", "year"), "doc_id")
        among(dated.filter(known_bucket(F.col("year"), F.col("known_year")) == f.cve[6:]))
    elif f.cve:
        found = tables["near_codes"].filter(F.col("actor") == f.cve_near) if f.cve_near else tables["codes"]
        among(found.filter(F.col("code") == f.cve.upper()))
    if f.technique:
        column, value = ("tactic", f.technique[7:]) if f.technique.startswith("tactic:") else ("technique", f.technique.upper())
        among(tables["techniques"].filter(F.col(column) == value))
    if f.cite and (cite := parse_cite(f.cite)):
        among(citing(tables["citations"], tables["documents"], tables["sources"], *cite))
    return docs


def ranked_hits(docs: DataFrame, asked: str, scores: DataFrame, literal: DataFrame) -> DataFrame:
    """doc_id, priority, score, reason of documents in order of relevance: an exact title (0), a title that holds the query
    (1), a text hit (2, with the search's own words or by an expansion) and a publisher's name (3).

    docs has doc_id, title, source; scores(doc_id, score) are the text hits, literal(doc_id) those without expansion.
    """
    needle = asked.strip().strip('"').lower()
    title, publisher = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("source", F.lit("")))
    joined = docs.join(scores.select("doc_id", "score"), "doc_id", "left").join(literal.select("doc_id", F.lit(True).alias("literal")), "doc_id", "left")
    hit = F.col("score").isNotNull()
    asked_for = F.lit(bool(needle))
    priority = F.when(asked_for & (title == needle), 0).when(asked_for & title.contains(needle), 1).when(hit, 2).when(asked_for & publisher.contains(needle), 3)
    reason = F.when(priority == 0, "Exact title").when(priority == 1, "Title").when((priority == 2) & F.col("literal"), "Indexed text").when(priority == 2, "Expanded search term").otherwise("Publisher name")
    return joined.withColumns({"priority": priority, "reason": reason}).filter("priority is not null").withColumn("score", F.coalesce("score", F.lit(0.0)))


def relevance(hits: DataFrame) -> list[Column]:
    """The total order of ranked hits: class, score (higher first), a work's own file, id."""
    return [F.col("priority"), F.col("score").desc(), (F.col("work_id").isNotNull() & (F.col("work_id") != F.col("doc_id"))), F.col("doc_id")]


def best_editions(hits: DataFrame) -> DataFrame:
    """The most relevant file of each work among hits that are filtered already."""
    w = Window.partitionBy(F.coalesce("work_id", "doc_id")).orderBy(*relevance(hits))
    return hits.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def by_topic_scores(docs: DataFrame, topics: DataFrame, chosen: list[str]) -> DataFrame:
    """doc_id, score: documents by the sum of their scores in the chosen topics; all of those must be there."""
    per = topics.filter(F.col("topic").isin(*chosen)).groupBy("doc_id").agg(F.round(F.sum("score"), 2).alias("score"), F.count("*").alias("k"))
    return docs.select("doc_id").join(per.filter(F.col("k") == len(set(chosen))), "doc_id").select("doc_id", "score")


def expand_query(words: list[str], concepts: dict[str, list[str]], longest_exact: int = 4, least: int = 3, most: int = 40) -> list[list[str]]:
    """Alternatives for each word of a query: the word as a prefix and the names of its concept in other languages.

    Names of fewer than `least` letters are left out, those of up to `longest_exact` match whole, longer ones as prefixes; an
    alternative that a shorter prefix covers is dropped; `most` names are added at most, shortest first.
    """
    out = []
    for word in words:
        names = sorted({n.lower() for n in concepts.get(word.lower(), ()) if len(n) >= least}, key=lambda n: (len(n), n))
        kept = [f"{word.lower()}*"]
        for n in names:
            if len(kept) > most:
                break
            term = n if len(n) <= longest_exact else f"{n}*"
            if not any(k.endswith("*") and n.startswith(k[:-1]) for k in kept):
                kept.append(term)
        out.append(kept)
    return out


def search_any(counts: DataFrame, groups: list[list[str]]) -> DataFrame:
    """doc_id of documents with a hit of each group; a term that ends in * is a beginning of a word."""

    def one(term: str) -> Column:
        return F.col("token").startswith(term[:-1]) if term.endswith("*") else F.col("token") == term

    flags = [F.max(_any([one(t) for t in g])).alias(f"g{i}") for i, g in enumerate(groups)]
    return counts.groupBy("doc_id").agg(*flags).filter(" and ".join(f"g{i}" for i in range(len(groups)))).select("doc_id")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def low_relevance(title: Column, url: Column) -> Column:
    """Whether a file is an administrative paper or no paper at all, by its title and address."""
    papers = r"\b(privacy|cookie|terms of use|tender|procurement|job|vacancy|careers|invoice|agenda)\b"
    return F.lower(title).rlike(papers) | F.lower(url).rlike(r"\.(jpe?g|png|gif|css|js|zip|exe)($|[?#])|/(login|search|cart)\b")


def same_family(url: Column, homes: Column) -> Column:
    """Whether an address is of one of the domain families in homes, an array."""
    from quillon.functions.scalar import domain_family

    return F.array_contains(homes, domain_family(url))


def graph_ties(ties: DataFrame, entity=None, layer: str | None = None, rel: str | None = None, least: float | None = None, not_a_tie: tuple[str, ...] = ()) -> DataFrame:
    """Ties(a, b, rel, layer, weight) by entity, layer, relation and weight; rival relations (not_a_tie) don't connect."""
    if entity is not None:
        ties = ties.filter((F.col("a") == F.lit(entity)) | (F.col("b") == F.lit(entity)))
    if layer:
        ties = ties.filter(F.col("layer") == layer)
    if rel:
        ties = ties.filter(F.col("rel") == rel)
    if least is not None:
        ties = ties.filter(F.col("weight") >= least)
    return ties.filter(~F.col("rel").isin(*not_a_tie)) if not_a_tie else ties


def event_rows(events: DataFrame, kind: str | None = None, since=None, until=None, label: str | None = None) -> DataFrame:
    """Events by kind, time and a piece of their label (any case)."""
    if kind:
        events = events.filter(F.col("event_type") == kind)
    if since:
        events = events.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until:
        events = events.filter(F.col("ts") < F.lit(until).cast("timestamp"))
    if label:
        events = events.filter(F.col("props").ilike("%" + re.sub(r"([%_\\])", r"\\\1", label) + "%"))
    return events
