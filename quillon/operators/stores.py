"""Stores and imports: schemas, catalogues, feeds, crawls, inboxes, notebooks, books, and verdicts that outlive a rebuild."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def migrated(df: DataFrame, schema: StructType) -> DataFrame:
    """df with the schema's columns in its order and types: columns that it lacks are null, others are kept behind."""
    own = {f.name: f for f in df.schema}
    wanted = [(F.col(f.name) if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*wanted, *[c for c in df.columns if c not in schema.names])


def catalogue(spark: SparkSession, entries: dict) -> DataFrame:
    """topic, category, term, lang, english of a taxonomy {category: {topic: {lang: [terms]}}}, a file of bounded size. A term of
    another language counts in English texts only if an English term of its topic begins alike (five letters)."""
    rows = []
    for category, topics in entries.items():
        for topic, langs in topics.items():
            english = {t.rstrip("*")[:5].lower() for t in langs.get("en", [])}
            rows += [(topic, category, t, lang, lang == "en" or t.rstrip("*")[:5].lower() in english) for lang, terms in langs.items() for t in terms]
    return spark.createDataFrame(rows, "topic string, category string, term string, lang string, english boolean")


def scoped_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, topic, term: the single words to look for in each document; English ones are spared false friends."""
    single = terms.filter(~F.col("term").contains(" "))
    return docs.select("doc_id", "english").withColumnRenamed("english", "is_english").join(F.broadcast(single)).filter("not is_english or english").select("doc_id", "topic", "term")  # a taxonomy


def json_records(spark: SparkSession, path: str, schema: str, at: str) -> DataFrame:
    """The records that a JSON catalogue holds in the array `at`; one file, read whole."""
    whole = spark.read.schema(f"{at} array<struct<{schema}>>").option("multiLine", True).json(path)
    return whole.select(F.explode(at).alias("r")).select("r.*")


def incidents(rows: DataFrame, since: int = 2000) -> DataFrame:
    """event, year, role, name of a feed's rows(id, year, initiators, receivers), whose names are lists with semicolons."""
    kept = rows.filter(F.col("year") >= since)
    parts = None
    for role, column in (("initiator", "initiators"), ("receiver", "receivers")):
        names = F.array_distinct(F.filter(F.transform(F.split(column, ";"), lambda x: F.trim(x)), lambda x: x != ""))
        own = kept.select(F.col("id").alias("event"), "year", F.lit(role).alias("role"), F.explode(names).alias("name"))
        parts = own if parts is None else parts.unionByName(own)
    return parts


def conflict_events(rows: DataFrame, countries: list[str], least: int = 50) -> DataFrame:
    """Single events of a conflict feed(id, country, deaths, clarity, precision) that are worth a line: `least` deaths, a clear
    report, a date known to three days, a country of the library."""
    return rows.filter((F.col("deaths") >= least) & (F.col("clarity") == 1) & F.col("precision").between(1, 3) & F.col("country").isin(*countries))


def wikidata_items(items: DataFrame, countries: list[str], actors: DataFrame) -> DataFrame:
    """Items(item, country, participants) in one of the library's countries or with a known actor."""
    known = items.select("item", F.explode("participants").alias("actor")).join(actors.select("actor"), "actor", "left_semi").select("item").distinct().withColumn("named", F.lit(True))
    return items.join(known, "item", "left").filter(F.col("country").isin(*countries) | F.col("named")).drop("named")


def crawl(pages: DataFrame, links: DataFrame, stored: DataFrame, cutoff) -> DataFrame:
    """source, url: new files of the stale pages(source, page, crawled): each address once, for the first source by name, those
    that the library has left out. links has page, url."""
    stale = pages.filter(F.col("crawled").isNull() | (F.col("crawled") < F.lit(cutoff).cast("timestamp")))
    found = stale.select("source", "page").join(links, "page").groupBy("url").agg(F.min("source").alias("source"))
    return found.join(stored.select("url"), "url", "left_anti").select("source", "url")


def imported(files: DataFrame, stored: DataFrame, by: str, homes: DataFrame) -> DataFrame:
    """sha256, name, status, by, official of an inbox's files(name, content, url): a file that the library or the inbox has
    already is a duplicate; one whose address is of its publisher's domain family is official (homes: family)."""
    from quillon.functions.scalar import domain_family

    f = files.withColumns({"sha256": F.sha2("content", 256), "family": domain_family(F.col("url"))})
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("name")) == 1
    have = stored.select("sha256", F.lit(True).alias("have")).distinct()
    joined = f.withColumn("first", first).join(have, "sha256", "left").join(homes.select("family", F.lit(True).alias("official")).distinct(), "family", "left")
    return joined.select("sha256", "name", F.when(F.col("have") | ~F.col("first"), "duplicate").otherwise("stored").alias("status"), F.lit(by).alias("by"), F.coalesce("official", F.lit(False)).alias("official"))


def tier_panel(reports: DataFrame, tiers: list[str]) -> DataFrame:
    """country, tier of reports(text) that list countries below tier headings, `Tier name: A; B; C`."""
    parts = None
    for i, tier in enumerate(tiers):
        names = F.split(F.regexp_extract("text", rf"(?im)^{tier}:\s*([^\n]*)$", 1), r"\s*;\s*")
        own = reports.select(F.explode(names).alias("country"), F.lit(i + 1).alias("tier")).filter("country <> ''")
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("country").agg(F.min("tier").alias("tier"))


def holding(items: DataFrame, key: str) -> DataFrame:
    """Rows whose JSON object `names` has a key: the EXISTS over an unnested object as one higher-order test."""
    return items.filter(F.array_contains(F.map_keys(F.from_json("names", "map<string,int>")), key))


def sampled(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows in a random order that the seed and the key fix, so reruns agree."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(k)


def event_mentions(docs: DataFrame, events: DataFrame, window: int = 80) -> DataFrame:
    """event, doc_id of documents(doc_id, text, year) that name an event(event, name, year): not from before it, and with one use
    at least that has no earlier year within `window` characters before or behind it.

    A document's words join the names' first words, so only documents with that word are searched for a name.
    """
    from quillon.sources.library import TOKEN_GAP

    first = events.withColumn("first", F.lower(F.split("name", " ")[0]))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), TOKEN_GAP))).alias("first"))
    asked = words.join(first, "first").join(docs.select("doc_id", "text", F.col("year").alias("doc_year")), "doc_id").filter("doc_year is null or doc_year >= year")
    around = F.transform(F.regexp_extract_all("text", F.concat(F.lit(f"(?is)(.{{0,{window}}}\\b"), "name", F.lit(f"\\b.{{0,{window}}})")), F.lit(1)), lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1)), lambda y: y.cast("int")))
    clean = F.exists(around, lambda ys: ~F.exists(ys, lambda y: y < F.col("year")))
    return asked.filter(clean).select("event", "doc_id").distinct()


def console_groups(parts: dict[str, DataFrame], asked: str, k: int = 3) -> DataFrame:
    """grouping, name, n, rank: what a half-typed console word may mean, the k commonest of each group. Each part has name, n."""
    out = None
    for group, df in parts.items():
        own = df.filter(F.lower("name").startswith(asked.lower())).select(F.lit(group).alias("grouping"), "name", "n")
        out = own if out is None else out.unionByName(own)
    w = Window.partitionBy("grouping").orderBy(F.desc("n"), "name")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def merged_notes(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """url, sha256, note, at of two notebooks: of the same passage (url and hash of the quote) the later note stays."""
    both = ours.unionByName(theirs)
    return both.groupBy("url", "sha256").agg(F.max_by("note", F.struct("at", "note")).alias("note"), F.max("at").alias("at"))


def cited(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """note, line: a note with the report behind it as one line: publisher, title, year, page."""
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(", p. "), F.col("page").cast("string"))).otherwise("")
    year = F.coalesce(F.col("year").cast("string"), F.lit("n.d."))
    return notes.join(docs, "doc_id").select("note", F.concat("source", F.lit(": "), "title", F.lit(" ("), year, F.lit(")"), page).alias("line"))


def attributions(claims: DataFrame, located: DataFrame, actors: DataFrame) -> DataFrame:
    """actor, claims, proven: attributions to an actor, and those whose quote was found in its source."""
    joined = claims.join(located.select("claim_id", "place"), "claim_id", "left")
    return joined.groupBy("actor").agg(F.count("*").alias("claims"), F.count("place").alias("proven")).join(actors.select("actor"), "actor", "left_semi")


def chapters_of(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """book, page, chapter: the chapter that a page is in, the last one to begin on or before it. chapters: book, chapter, first."""
    starts = chapters.select("book", F.col("first").alias("page"), "chapter", F.lit(0).alias("o"))
    asked = pages.select("book", "page", F.lit(None).cast(chapters.schema["chapter"].dataType).alias("chapter"), F.lit(1).alias("o"))
    w = Window.partitionBy("book").orderBy("page", "o").rowsBetween(Window.unboundedPreceding, 0)
    return starts.unionByName(asked).withColumn("chapter", F.last("chapter", ignorenulls=True).over(w)).filter("o = 1").select("book", "page", "chapter")


def actors_by_chapter(named: DataFrame, chapters: DataFrame) -> DataFrame:
    """book, chapter, actor, n of mentions(book, page, actor)."""
    placed = named.join(chapters_of(named.select("book", "page").distinct(), chapters), ["book", "page"])
    return placed.groupBy("book", "chapter", "actor").agg(F.count("*").alias("n"))


def printed_contents(text: Column) -> Column:
    """Title and page of the lines of a printed table of contents: `1 Title ..... 12`."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^\s*((?:[0-9]+(?:\.[0-9]+)*\.?\s+)?\S.*?)\s*\.{3,}\s*[0-9]+\s*$"), F.lit(1))
    pages = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:[0-9]+(?:\.[0-9]+)*\.?\s+)?\S.*?\s*\.{3,}\s*([0-9]+)\s*$"), F.lit(1))
    return F.zip_with(lines, pages, lambda a, b: F.struct(a.alias("title"), b.cast("int").alias("page")))


def index_entries(text: Column) -> Column:
    """Headword and pages of a back index's lines, `Name, Forename, 12, 14-16`: ranges are written out."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^(\p{L}[^\n]*?,\s*[0-9][0-9,\s–-]*)$"), F.lit(1))

    def entry(line: Column) -> Column:
        tail = F.regexp_extract(line, r",\s*([0-9][0-9,\s–-]*)$", 1)
        spans = F.transform(F.split(tail, r"\s*,\s*"), lambda p: F.transform(F.split(F.trim(p), "[–-]"), lambda x: x.cast("int")))
        pages = F.flatten(F.transform(spans, lambda s: F.sequence(s[0], F.element_at(s, -1))))
        return F.struct(F.regexp_replace(line, r",\s*[0-9][0-9,\s–-]*$", "").alias("head"), pages.alias("pages"))

    return F.transform(lines, entry)


def book_metadata(parts: list[tuple[str, DataFrame]], key: str, fields: list[str]) -> DataFrame:
    """key and for each field its value and where it is from: the first of parts (name, DataFrame), best first, that knows it."""
    out = None
    for name, df in parts:
        own = df.select(key, *[F.when(F.col(f).isNotNull(), F.struct(F.col(f).cast("string").alias("v"), F.lit(name).alias("by"))).alias(f"{name}__{f}") for f in fields])
        out = own if out is None else out.join(own, key, "full_outer")
    best = {f: F.coalesce(*[F.col(f"{name}__{f}") for name, _ in parts]) for f in fields}
    return out.select(key, *[x for f in fields for x in (best[f]["v"].alias(f), best[f]["by"].alias(f"{f}_by"))])


def page_label(labels: Column, page: Column) -> Column:
    """The printed label of a page, its number where the book has none."""
    return F.coalesce(F.element_at(labels, page), page.cast("string"))


def invalidated(derived: DataFrame, texts: DataFrame) -> DataFrame:
    """Derived rows(doc_id, sha256, ...) whose document's text is still the one that they were made from."""
    return derived.join(texts.select("doc_id", F.sha2("text", 256).alias("sha256")), ["doc_id", "sha256"], "left_semi")


def with_verdicts(found: DataFrame, verdicts: DataFrame, keys: list[str], accepted: bool = False) -> DataFrame:
    """found without what a reviewer rejected, by the last of verdicts(keys, verdict, at); with accepted=True only what one
    accepted."""
    last = verdicts.groupBy(*keys).agg(F.max_by("verdict", "at").alias("__verdict"))
    joined = found.join(last, keys, "left")
    test = F.col("__verdict") == "accepted" if accepted else F.coalesce("__verdict", F.lit("")) != "rejected"
    return joined.filter(test).drop("__verdict")


def restored(tables: dict[str, DataFrame], private: dict[str, Column]) -> dict[str, DataFrame]:
    """A dataset's tables for an empty library, private rows dropped."""
    return {name: df.filter(~private[name]) if name in private else df for name, df in tables.items()}


def lists_merged(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """key, value, by of two hand-kept lists(key, value, at): a later entry wins, ours on ties."""
    both = ours.select("key", "value", "at", F.lit(1).alias("p")).unionByName(theirs.select("key", "value", "at", F.lit(0).alias("p")))
    best = both.groupBy("key").agg(F.max(F.struct("at", "p", "value")).alias("x"))
    return best.select("key", F.col("x.value").alias("value"), F.when(F.col("x.p") == 1, "ours").otherwise("theirs").alias("by"))


def link_of(params: dict, base: str = "/documents") -> str:
    """The address that lists what a number counts: its parameters in order, empty ones left out."""
    from urllib.parse import urlencode

    kept = [(k, v) for k, v in params.items() if v not in (None, "", False)]
    return base + ("?" + urlencode(kept) if kept else "")


def markdown_table(df: DataFrame) -> DataFrame:
    """One text column: a row's cells between bars."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |")).alias("value"))


def history_row(counts: dict[str, DataFrame], at: str) -> DataFrame:
    """step, n, at: what an update run did, one row a step."""
    out = None
    for step, df in counts.items():
        own = df.agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "n", F.lit(at).alias("at"))
        out = own if out is None else out.unionByName(own)
    return out


def usable_names(names: DataFrame, generic: list[str]) -> DataFrame:
    """actor, name: names(actor, name, kind, is_label) fit for narratives: six letters at least, no generic word; a single word only
    as a group's own label; a nom de guerre of three words at least."""
    from quillon.operators.matching import KUNYA

    words = F.split(F.lower(F.trim("name")), r"\s+")
    single, kunya = F.size(words) == 1, words[0].isin(*KUNYA)
    return names.filter((F.length(F.trim("name")) >= 6) & ~F.lower("name").isin(*generic) & (~single | (F.col("is_label") & (F.col("kind") != "person"))) & (~kunya | (F.size(words) >= 3))).select("actor", "name")


def layer_choice(ties: DataFrame, choice: str) -> DataFrame:
    """Ties under a choice of layers: connecting (no rivals), stated (no co-mentions), official, reference or all."""
    tests = {"connecting": ~F.col("rel").rlike("rival|oppos"), "stated": F.col("layer") != "reports", "official": F.col("layer") == "official", "reference": F.col("layer").isin("official", "reference"), "all": F.lit(True)}
    return ties.filter(tests[choice])


def concepts(rows: DataFrame) -> DataFrame:
    """key, concepts: the concepts that a folded name stands for; more than one makes it ambiguous."""
    return rows.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.array_join(F.sort_array(F.collect_set("concept")), ",").alias("concepts"))


def gazetteer(items: DataFrame, classes: list[str], designated: DataFrame, most: int = 25) -> DataFrame:
    """item, why, rank: items(item, class, notability) of the wanted classes or designated by a list, the `most` notable of each
    reason."""
    by_class = items.filter(F.col("class").isin(*classes)).select("item", F.lit("class").alias("why"), "notability")
    by_list = items.join(designated.select("item"), "item", "left_semi").select("item", F.lit("designated").alias("why"), "notability")
    w = Window.partitionBy("why").orderBy(F.desc("notability"), "item")
    return by_class.unionByName(by_list).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("item", "why", "rank")


def progress_line(step: str, done: int, total: int) -> str:
    """A job's log line."""
    return json.dumps({"step": step, "done": done, "total": total, "share": round(done / total, 4) if total else 1.0})
