"""Citations: addresses in texts, what they lead to, and who cites whom; codes and techniques in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import address_norm, host

ADDRESS = r"https?://[^\s<>\"'\])}]+"
SPANS = 20


def match_spans(text: Column, pattern: str) -> Column:
    """All matches as an array of structs found, start (from 0), end: places follow from the lengths of the pieces between the
    matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("m"), F.transform(F.slice(gaps, F.lit(1), F.size(found)), lambda g: F.length(g)).alias("gap"))
    zero = F.array().cast("array<struct<found:string,start:int,end:int>>")

    def step(out: Column, p: Column) -> Column:
        start = F.coalesce(F.get(out, F.size(out) - 1)["end"], F.lit(0)) + p["gap"]
        return F.concat(out, F.array(F.struct(p["m"].alias("found"), start.alias("start"), (start + F.length(p["m"])).alias("end"))))

    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, step)).otherwise(zero)


def code_marks(docs: DataFrame, last: int, spans: int = SPANS) -> DataFrame:
    """doc_id, code, n, first, places: numbers of vulnerabilities with any hyphen, from 1999 to `last`, how often and where first;
    the places of the first `spans` uses of each."""
    pattern = r"(?i)CVE[-‐‑‒–—][0-9]{4}[-‐‑‒–—][0-9]{4,7}"
    marks = docs.select("doc_id", F.explode(match_spans(F.col("text"), pattern)).alias("s"))
    code = F.upper(F.regexp_replace("s.found", "[‐‑‒–—]", "-"))
    return marks.select("doc_id", code.alias("code"), "s.start").filter(F.substring("code", 5, 4).cast("int").between(1999, last)).groupBy("doc_id", "code").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.slice(F.sort_array(F.collect_list("start")), 1, spans).alias("places"))


def technique_marks(docs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """doc_id, technique, n, known: technique numbers; those that the catalogue(technique) lacks are counted apart."""
    marks = docs.select("doc_id", F.explode(match_spans(F.col("text"), r"\bT1[0-9]{3}(?:\.[0-9]{3})?\b")).alias("s"))
    per = marks.groupBy("doc_id", F.col("s.found").alias("technique")).agg(F.count("*").alias("n"))
    return per.join(catalogue.select("technique", F.lit(True).alias("known")), "technique", "left").na.fill(False, ["known"])


def addresses(docs: DataFrame) -> DataFrame:
    """doc_id, url, address, host, n: the different addresses that a text writes, closing punctuation dropped."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(ADDRESS), F.lit(0))).alias("url")).withColumn("url", F.regexp_replace("url", r"[.,;:!?]+$", ""))
    return found.groupBy("doc_id", address_norm(F.col("url")).alias("address")).agg(F.min("url").alias("url"), F.count("*").alias("n")).withColumn("host", host(F.col("url"))).filter("host <> ''")


def homes_of(address: Column) -> Column:
    """The homes that an address may belong to, best first: its host with ever shorter paths, then the host's parents down to
    two labels."""
    parts = F.split(address, "/")
    paths = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    labels = F.split(parts[0], r"\.")
    parents = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(2), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    return F.concat(paths, parents)


def site_of(urls: DataFrame, homes: DataFrame) -> DataFrame:
    """address, source: the source with the best home(home, source) of each address. A home that two sources share
    resolves nothing, and hides the less good ones."""
    own = homes.groupBy("home").agg(F.min("source").alias("source"), F.count_distinct("source").alias("owners"))
    probes = urls.select("address").distinct().select("address", F.posexplode(homes_of(F.col("address"))).alias("place", "home"))
    best = probes.join(own, "home").groupBy("address").agg(F.min_by(F.struct("source", "owners"), "place").alias("x"))
    return best.filter("x.owners = 1").select("address", "x.source")


def resolved(docs: DataFrame, homes: DataFrame) -> DataFrame:
    """doc_id, address, host, n, to_doc, to_source: what the texts cite. docs has doc_id, text, url.

    An address leads to the document with it, if just one has it, and else to the source whose site it is on, else it is
    an outside host's. Links to a document's own site are dropped.
    """
    own = docs.select("doc_id", address_norm(F.col("url")).alias("address"))
    by_address = own.groupBy("address").agg(F.min("doc_id").alias("to_doc"), F.count("*").alias("k")).filter("k = 1").select("address", "to_doc")
    found = addresses(docs)
    sites = site_of(found.select("address").unionByName(own.select("address")), homes)
    mine = own.join(sites, "address").select("doc_id", F.col("source").alias("own_source"))
    joined = found.join(by_address, "address", "left").join(sites.withColumnRenamed("source", "to_source"), "address", "left").join(mine, "doc_id", "left")
    kept = joined.filter("(own_source is null or to_source is null or own_source <> to_source) and (to_doc is null or to_doc <> doc_id)")
    return kept.select("doc_id", "address", "host", "n", "to_doc", "to_source")


def overview(citations: DataFrame, docs: DataFrame, sources: DataFrame) -> DataFrame:
    """citing, cited, links, docs: flows between types of publishers, a source's links to itself left out. docs has doc_id,
    source; sources source, publisher."""
    ends = citations.filter("to_source is not null").join(docs.select("doc_id", "source"), "doc_id").filter("source <> to_source")
    typed = ends.join(sources.select("source", F.col("publisher").alias("citing")), "source").join(sources.select(F.col("source").alias("to_source"), F.col("publisher").alias("cited")), "to_source")
    return typed.groupBy("citing", "cited").agg(F.count("*").alias("links"), F.count_distinct("doc_id").alias("docs"))


def totals(citations: DataFrame) -> DataFrame:
    """kind, target, links, docs: cited documents, sources and outside hosts by the documents that cite them."""
    kind = F.when(F.col("to_doc").isNotNull(), "document").when(F.col("to_source").isNotNull(), "source").otherwise("host")
    target = F.coalesce(F.col("to_doc").cast("string"), "to_source", "host")
    return citations.groupBy(kind.alias("kind"), target.alias("target")).agg(F.count("*").alias("links"), F.count_distinct("doc_id").alias("docs"))


def of_documents(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, cites, cited_by, agencies, hosts of every document: documents that it cites and that cite it, other sources'
    sites and outside hosts that it links to."""
    out = citations.groupBy("doc_id").agg(F.count_distinct("to_doc").alias("cites"), F.count_distinct(F.when(F.col("to_doc").isNull(), F.col("to_source"))).alias("agencies"), F.count_distinct(F.when(F.col("to_doc").isNull() & F.col("to_source").isNull(), F.col("host"))).alias("hosts"))
    back = citations.filter("to_doc is not null").groupBy(F.col("to_doc").alias("doc_id")).agg(F.count_distinct("doc_id").alias("cited_by"))
    return docs.select("doc_id").join(out, "doc_id", "left").join(back, "doc_id", "left").na.fill(0).select("doc_id", "cites", "cited_by", "agencies", "hosts")


def code_overview(codes: DataFrame, docs: DataFrame) -> DataFrame:
    """code, docs, agencies, countries, first, last, known of codes named by documents in scope."""
    rows = codes.join(docs, "doc_id")
    return rows.groupBy("code").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("source").alias("agencies"), F.count_distinct("country").alias("countries"), F.min("year").alias("first"), F.max("year").alias("last"), F.max(F.col("known_year").isNotNull()).alias("known"))


def code_lags(codes: DataFrame, docs: DataFrame) -> DataFrame:
    """measure, bucket, pairs, docs: reports and codes by the code's age in the report's year, and by the order of the report
    and the code's listing."""
    from quillon.operators.scope import age_bucket, known_bucket

    rows = codes.join(docs, "doc_id").filter("year is not null")
    age = rows.select(F.lit("age").alias("measure"), age_bucket(F.col("year"), F.col("code_year")).cast("string").alias("bucket"), "doc_id", "code")
    known = rows.select(F.lit("listing").alias("measure"), known_bucket(F.col("year"), F.col("known_year")).alias("bucket"), "doc_id", "code").filter("bucket is not null")
    return age.unionByName(known).groupBy("measure", "bucket").agg(F.count("*").alias("pairs"), F.count_distinct("doc_id").alias("docs"))


def actor_codes(near: DataFrame, docs: DataFrame) -> DataFrame:
    """actor, code, docs: codes named within a passage of an actor, by documents in scope."""
    return near.join(docs.select("doc_id"), "doc_id").groupBy("actor", "code").agg(F.count_distinct("doc_id").alias("docs"))


def tactic_grid(techniques: DataFrame, docs: DataFrame, k: int = 12) -> DataFrame:
    """tactic, technique, docs, tactic_docs, rank: the k techniques of each tactic that most documents name, and the documents
    that name any of it."""
    rows = techniques.filter("tactic is not null").join(docs.select("doc_id"), "doc_id")
    per = rows.groupBy("tactic", "technique").agg(F.count_distinct("doc_id").alias("docs"))
    whole = rows.groupBy("tactic").agg(F.count_distinct("doc_id").alias("tactic_docs"))
    w = Window.partitionBy("tactic").orderBy(F.desc("docs"), "technique")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).join(whole, "tactic")
