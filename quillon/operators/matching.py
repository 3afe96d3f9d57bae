"""Names as records: preparation with reasons, matching in texts with guards, and matching between registers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.library import TOKEN_GAP

CONTEXT, LONG, UPPER = 6, 5, 6
#: Rows of a table of names that are sent to every task; longer tables are joined by a shuffle of all tokens.
MOST_SENT = 500_000
#: Different first words that tokens are tested for before their surroundings are made.
MOST_FIRST = 10_000
#: Words before and after a person's name that make it another thing's name.
SHIPS = ["uss", "hms", "ss", "mv"]
NAMED_AFTER = ["street", "airport", "prize", "university", "jr", "sr"]
#: First words of a nom de guerre that many carry.
KUNYA = ["abu", "abou", "umm"]


def name_tokens(name: Column) -> Column:
    """A name's tokens as written, without what stands in brackets."""
    return F.array_remove(F.split(F.regexp_replace(name, r"\([^)]*\)", " "), TOKEN_GAP), "")


def name_key(name: Column) -> Column:
    """Lower-case words in the order written, one space between."""
    return F.array_join(F.array_remove(F.split(F.lower(name), TOKEN_GAP), ""), " ")


def is_abbreviation(tokens: Column) -> Column:
    return (F.size(tokens) == 1) & tokens[0].rlike(r"^[\p{Lu}\p{N}]{2,6}$")


def prepared(names: DataFrame, ignore: list[str], generic: list[str]) -> DataFrame:
    """actor, name, tokens, manual, person, status, reason of names(actor, name, kind, label, manual): one row for each
    actor's different names, with the first rule that keeps a name from being matched.

    An actor's own label wins over another one's alias of several words; a name that several actors share is else nobody's.
    """
    toks = name_tokens(F.col("name"))
    own = names.withColumn("tokens", toks).withColumn("is_label", F.col("tokens") == name_tokens(F.col("label")))
    own = own.groupBy("actor", "tokens").agg(F.min("name").alias("name"), F.max("manual").alias("manual"), F.max(F.col("kind") == "person").alias("person"), F.max("is_label").alias("is_label"), F.max("label").alias("label"))
    w = Window.partitionBy("tokens")
    shared = own.withColumns({"owners": F.count("*").over(w), "labelled": F.count_if(F.col("is_label") & ~F.col("person")).over(w)})
    t, joined, first = F.col("tokens"), F.array_join("tokens", ""), F.col("tokens")[0]
    one = F.size(t) == 1
    surname = F.element_at(name_tokens(F.col("label")), -1)
    low = F.lower(F.array_join(t, " "))
    rules = [
        ("no letters", F.size(t) == 0),
        ("lowercase words", F.forall(t, lambda x: (x == F.lower(x)))),
        ("too short", (F.length(joined) < 3) | ((F.size(t) > 1) & F.forall(t, lambda x: F.length(x) <= 2))),
        ("on the ignore list", low.isin(*ignore) if ignore else F.lit(False)),
        ("one word that is not the surname", one & F.col("person") & ~F.col("manual") & (F.when(F.size(t) > 0, first) != surname)),
        ("a generic word", one & (low.isin(*generic) if generic else F.lit(False))),
        ("3 letters without being an abbreviation", one & (F.length(joined) == 3) & (joined != F.upper(joined))),
        ("the name of another actor", (F.col("owners") > 1) & (F.col("labelled") == 1) & (F.size(t) > 1) & ~F.col("is_label")),
        ("shared", (F.col("owners") > 1) & ~((F.col("labelled") == 1) & (F.size(t) > 1))),
    ]
    reason = F.lit(None).cast("string")
    for why, test in reversed(rules):
        reason = F.when(test, why).otherwise(reason)
    out = shared.withColumn("reason", reason)
    return out.select("actor", "name", "tokens", "manual", "person", F.when(F.col("reason").isNull(), "used").otherwise("ignored").alias("status"), F.coalesce("reason", F.lit("")).alias("reason"))


def marks(docs: DataFrame, ahead: int, begins=None) -> DataFrame:
    """doc_id, at, before, words: each token's place, the CONTEXT tokens before it, and it with the `ahead` tokens behind it. A
    row holds its surroundings and not the text, so the rows of a long document grow with its length alone. With a test
    begins(token) only tokens that pass it have a row."""
    own = F.array_remove(F.split("text", TOKEN_GAP), "")

    def around(words: Column) -> Column:
        at = F.transform(words, lambda w, i: F.when(begins(w), i) if begins else i)
        return F.transform(F.array_compact(at), lambda i: F.struct(i.alias("at"), F.slice(words, F.greatest(i - CONTEXT + 1, F.lit(1)), F.least(F.lit(CONTEXT), i)).alias("before"), F.slice(words, i + 1, F.lit(ahead + 1)).alias("words")))

    places = F.flatten(F.transform(F.array(own), around))  # the words are split once for a document
    return docs.select("doc_id", F.explode(places).alias("p")).select("doc_id", "p.at", "p.before", "p.words")


def found(docs: DataFrame, names: DataFrame, context: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, actor, name, at, upto (token places): all matches of names(actor, name, tokens, manual, person), before overlaps
    are settled.

    A token joins the names that begin with it, an equi-join; the words after it are compared in the document's array. Up to
    MOST_SENT rows of names, which are counted, come to where the document is, so that only hits are shuffled; up to MOST_FIRST
    different first words are looked for before surroundings are made. Names
    also match in capitals (six letters or more), and hand-added single words with up to three letters of inflection. A
    person's name isn't matched behind a ship's prefix or before a word that makes it a place's or a prize's, and a name with
    context words (context: name -> beginnings) only within six tokens of one.
    """
    plain = names.select("actor", "name", "tokens", "person", F.col("tokens")[0].alias("first"), F.lit(0).alias("tail"))
    big = F.transform("tokens", lambda t: F.upper(t))
    upper = names.filter((F.length(F.array_join("tokens", "")) >= UPPER) & (big != F.col("tokens"))).select("actor", "name", big.alias("tokens"), "person", big[0].alias("first"), F.lit(0).alias("tail"))
    bare = names.filter(F.col("manual") & (F.size("tokens") == 1) & (F.length(F.col("tokens")[0]) >= LONG) & ~is_abbreviation(F.col("tokens")))
    bent = bare.select("actor", "name", "tokens", "person", F.col("tokens")[0].alias("first"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("tail"))
    table = plain.unionByName(upper).unionByName(bent)
    longest_name, rows = names.agg(F.max(F.size("tokens")), F.count("*")).first()
    longest_name = longest_name or 1
    if rows * 5 <= MOST_SENT:  # as written, in capitals, and with three lengths of endings
        table = F.broadcast(table)
    firsts = table.groupBy("first").agg(F.max("tail").alias("tail")).filter("first is not null").limit(MOST_FIRST + 1).collect()

    def begins(word: Column) -> Column:
        bent = [r["first"] for r in firsts if r["tail"]]
        ends = [F.substring(word, F.lit(1), F.length(word) - k).isin(bent) for k in (1, 2, 3)] if bent else []
        return reduce(lambda x, y: x | y, ends, word.isin([r["first"] for r in firsts]))

    placed = marks(docs, longest_name + CONTEXT, begins if len(firsts) <= MOST_FIRST else None).withColumn("word", F.col("words")[0])
    tails = F.array(F.struct(F.col("word").alias("first"), F.lit(0).alias("tail")), *[F.when(F.col("word").rlike(rf"\p{{Ll}}{{{k}}}$") & (F.length("word") > k), F.struct(F.expr(f"substring(word, 1, length(word) - {k})").alias("first"), F.lit(k).alias("tail"))) for k in (1, 2, 3)])
    probes = placed.withColumn("probe", F.explode(F.array_compact(tails))).select("doc_id", "before", "words", "at", F.col("probe.first").alias("first"), F.col("probe.tail").alias("tail"))
    hits = probes.join(table, ["first", "tail"])
    k = F.size("tokens")
    same = (F.col("tail") > 0) | (F.slice("words", F.lit(1), k) == F.col("tokens"))
    before, after = F.lower(F.get("before", F.size("before") - 1)), F.lower(F.get("words", k))
    another = F.col("person") & (F.coalesce(before.isin(*SHIPS), F.lit(False)) | F.coalesce(after.isin(*NAMED_AFTER), F.lit(False)))
    hits = hits.filter(same & ~another)
    if context:
        around = F.concat("before", F.slice("words", k + 1, F.lit(CONTEXT)))
        test = F.lit(True)
        for name, stems in context.items():
            near = F.exists(around, lambda w: w.rlike("(?i)" + "|".join(stems)))  # noqa: B023
            test = F.when(F.col("name") == name, near).otherwise(test)
        hits = hits.filter(test)
    return hits.select("doc_id", "actor", "name", F.col("at").cast("int").alias("at"), (F.col("at") + k).cast("int").alias("upto")).distinct()


def longest(hits: DataFrame) -> DataFrame:
    """Of overlapping matches the leftmost, of those the longest (then by name): in one pass over a document's sorted matches."""
    row = F.struct(F.col("at"), (-F.col("upto")).alias("m"), F.col("name"), F.col("actor"))
    per = hits.groupBy("doc_id").agg(F.sort_array(F.collect_set(row)).alias("hits"))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,m:int,name:string,actor:string>>").alias("kept"))
    kept = F.aggregate("hits", zero, lambda s, h: F.when(h["at"] >= s["end"], F.struct((-h["m"]).alias("end"), F.concat(s["kept"], F.array(h)).alias("kept"))).otherwise(s), lambda s: s["kept"])
    return per.select("doc_id", F.explode(kept).alias("h")).select("doc_id", "h.actor", "h.name", "h.at", (-F.col("h.m")).alias("upto"))


def corroborated(hits: DataFrame, weak: DataFrame, ordinary: DataFrame, excluded: DataFrame, wrong: DataFrame) -> DataFrame:
    """doc_id, actor, hits, names: matches (doc_id, source, actor, name) that count. Ordinary words(name) don't; an actor's
    excluded sources(actor, source) and matches that a reviewer found wrong (actor, doc_id) don't; one weak name(name) alone
    doesn't."""
    kept = hits.join(ordinary.select("name"), "name", "left_anti").join(excluded, ["actor", "source"], "left_anti").join(wrong, ["actor", "doc_id"], "left_anti")
    flagged = kept.join(weak.select("name", F.lit(True).alias("weak")), "name", "left")
    per = flagged.groupBy("doc_id", "actor").agg(F.count("*").alias("hits"), F.count_distinct("name").alias("names"), F.max(F.col("weak").isNull()).alias("strong"))
    return per.filter("strong or names > 1").select("doc_id", "actor", "hits", "names")


def listed_actors(entries: DataFrame, actors: DataFrame) -> DataFrame:
    """list, id, actor, via: entries(list, id, type, name, alias) that have an actor's name. actors has actor, kind, name.

    Kinds must fit (persons with persons, groups with the rest); a person's name has two words at least, an alias that begins
    with a nom de guerre three; a single word five letters; a name that two actors of fitting kinds share matches neither.
    """
    key = name_key(F.col("name"))
    e = entries.select("list", "id", "type", "alias", key.alias("key"), F.split(key, " ").alias("words"))
    person = F.col("type") == "person"
    e = e.filter((F.col("key") != "") & (~person | (F.size("words") >= 2)) & ~(person & F.col("alias") & (F.size("words") < 3) & F.col("words")[0].isin(*KUNYA)) & ((F.size("words") > 1) | (F.length("key") >= 5)))
    who = actors.select("actor", F.when(F.col("kind") == "person", "person").otherwise("group").alias("type"), key.alias("key")).distinct()
    who = who.withColumn("owners", F.count("*").over(Window.partitionBy("type", "key"))).filter("owners = 1").drop("owners")
    hits = e.join(who, ["type", "key"])
    return hits.groupBy("list", "id", "actor").agg(F.when(F.min(F.col("alias").cast("int")) == 0, "name").otherwise("alias").alias("via"))


def identity_edges(entries: DataFrame) -> DataFrame:
    """a, b, rule, place: entries(id, place, list, type, name, number, reference, birth) of different lists that look like one
    subject, in the order in which they are joined.

    1 an entry names another one's reference; 2 both have the same number and share a word of the name; 3 people of the same
    name in any order have the same full birth date, or with three words the same year; organisations have a name that is
    unique in each list. `place` is the entries' order; each set of equal keys gives a star round its first entry and not
    all pairs, but for people, whose dates are part of the key.
    """
    e = entries.withColumn("words", F.array_sort(F.array_distinct(F.array_remove(F.split(F.lower("name"), TOKEN_GAP), ""))))
    e = e.withColumn("key", F.array_join("words", " "))
    refers = e.filter("reference is not null").select(F.col("reference").alias("a"), F.col("id").alias("b"), "list", "place")
    one = refers.join(e.select(F.col("id").alias("a"), F.col("list").alias("la")), "a").filter("la <> list").select("a", "b", F.lit(1).alias("rule"), "place")

    def star(rows: DataFrame, keys: list[str], rule: int, test: Column | None = None) -> DataFrame:
        head = rows.groupBy(*keys).agg(F.min(F.struct("place", "id", "words", "list")).alias("h"))
        joined = rows.join(head, keys).filter((F.col("id") != F.col("h.id")) & (F.col("list") != F.col("h.list")))
        return (joined.filter(test) if test is not None else joined).select(F.col("h.id").alias("a"), F.col("id").alias("b"), F.lit(rule).alias("rule"), "place")

    two = star(e.filter("number is not null"), ["number"], 2, F.arrays_overlap("words", F.col("h.words")))
    named = e.filter((F.size("words") >= 2) & (F.length("key") >= 8))
    people = named.filter("type = 'person' and birth is not null")
    full = star(people.filter("length(birth) = 10"), ["key", "birth"], 3)
    year = star(people.filter(F.size("words") >= 3).withColumn("year", F.substring("birth", 1, 4)), ["key", "year"], 3)
    w = Window.partitionBy("type", "list", "key")
    single = named.filter("type <> 'person'").withColumn("n", F.count("*").over(w)).withColumn("worst", F.max("n").over(Window.partitionBy("type", "key"))).filter("worst = 1")
    orgs = star(single, ["type", "key"], 3)
    return one.unionByName(two).unionByName(full).unionByName(year).unionByName(orgs).distinct()


def identities(entries: DataFrame, edges: DataFrame, component) -> DataFrame:
    """id, subject (the smallest id of its group): edges are followed in order of rule and place, and one that would put two
    entries of a list into one group is not.

    The order matters within a connected part only, so parts are solved apart; component(edges) gives node, component.
    """
    part = component(edges.select("a", "b")).select(F.col("node").alias("id"), "component")
    lists = part.join(entries.select("id", "list"), "id")
    ends = edges.join(part.select(F.col("id").alias("a"), "component"), "a")
    tasks = ends.select("component", "a", "b", "rule", "place").withColumn("list", F.lit(None).cast("string")).unionByName(lists.select("component", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0).alias("rule"), F.lit(None).cast("long").alias("place"), "list"))

    def solve(pdf):
        import pandas as pd

        own = pdf[pdf["b"].isna()]
        group = {i: {i} for i in own["a"]}
        lists_of = {i: {x} for i, x in zip(own["a"], own["list"], strict=True)}
        for a, b in pdf[pdf["b"].notna()].sort_values(["rule", "place", "a"])[["a", "b"]].astype("int64").itertuples(index=False):
            x, y = group[a], group[b]
            if x is y or lists_of[min(x)] & lists_of[min(y)]:
                continue
            both = lists_of[min(x)] | lists_of[min(y)]
            x |= y
            for i in y:
                group[i] = x
            lists_of[min(x)] = both
        return pd.DataFrame({"id": list(group), "subject": [min(g) for g in group.values()]}).astype("int64")

    solved = tasks.groupBy("component").applyInPandas(solve, "id long, subject long")
    return entries.select("id").join(solved, "id", "left").withColumn("subject", F.coalesce("subject", "id"))


def shared_details(details: DataFrame, least: int = 2) -> DataFrame:
    """kind, key, targets: addresses, numbers and the like of details(target, kind, key) that `least` different targets give."""
    return details.groupBy("kind", "key").agg(F.count_distinct("target").alias("targets")).filter(F.col("targets") >= least)


def company_records(companies: DataFrame, records: DataFrame, least_number: int = 6) -> DataFrame:
    """company, how, records: companies(company, name, country, number, lei) in a register of records(lei, name, country,
    number): by the identifier; else by registration number in the country with a shared word of the name; else by the only
    record of the same name in the country.

    Companies that ask the same and records that answer the same meet once, and a list of records is made once for all
    companies that ask for it: no pair of a company and a record is a row but for identifiers. Only the rows of the result repeat a list.
    """
    key = name_key(F.col("name"))
    c = companies.filter("company is not null").select("company", "country", "number", F.col("lei").alias("own"), key.alias("key"))
    r = records.select(F.col("lei").alias("record"), "country", "number", key.alias("key"))
    by_id = c.join(r, F.col("own") == F.col("record")).groupBy("company").agg(F.array_join(F.sort_array(F.collect_set("record")), ",").alias("records"))
    rest = c.join(by_id, "company", "left_anti")

    numbered = rest.filter(F.length("number") >= least_number).filter("country is not null and key is not null")
    asks = numbered.groupBy("company").agg(F.sort_array(F.collect_set(F.struct("number", "country", "key"))).alias("asks"))
    each = asks.select("asks").distinct().select("asks", F.inline("asks"))
    answers = r.groupBy("number", "country", "key").agg(F.collect_set("record").alias("found"))
    words = lambda k: F.split(k, " ")
    met = each.select("number", "country", "key").distinct().join(answers.select("number", "country", F.col("key").alias("r_key")), ["number", "country"]).filter(F.arrays_overlap(words("key"), words("r_key")))
    lists = each.join(met, ["number", "country", "key"]).select("asks", "number", "country", F.col("r_key").alias("key")).distinct().join(answers, ["number", "country", "key"])
    listed = lists.groupBy("asks").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("found")))), ",").alias("records"))
    by_number = asks.join(listed, "asks").select("company", "records")

    same = r.filter(F.length("key") >= 5).groupBy("key", "country").agg(F.min("record").alias("low"), F.max("record").alias("high"))
    named = rest.join(same, ["key", "country"]).groupBy("company").agg(F.min("low").alias("records"), F.max("high").alias("high")).filter("records = high")
    answered = asks.join(each.join(met, ["number", "country", "key"], "left_semi").select("asks"), "asks", "left_semi")
    by_name = named.join(answered, "company", "left_anti").select("company", "records")
    return by_id.select("company", F.lit("lei").alias("how"), "records").unionByName(by_number.select("company", F.lit("registration").alias("how"), "records")).unionByName(by_name.select("company", F.lit("name").alias("how"), "records"))


def offshore_records(subjects: DataFrame, nodes: DataFrame, most: int = 3) -> DataFrame:
    """subject, how, nodes: subjects(subject, type, name, country) whose name's nodes(node, name, country) all share its
    country; of people's names no more than `most` nodes may have one."""
    key = name_key(F.col("name"))
    per = nodes.select("node", "country", key.alias("key")).groupBy("key").agg(F.collect_set("country").alias("countries"), F.sort_array(F.collect_set("node")).alias("nodes"))
    s = subjects.select("subject", "type", F.col("country").alias("own"), key.alias("key"))
    hits = s.join(per, "key").filter((F.size("countries") == 1) & (F.col("countries")[0] == F.col("own"))).filter((F.col("type") != "person") | (F.size("nodes") <= most))
    return hits.select("subject", F.when(F.col("type") == "person", "person").otherwise("company").alias("how"), F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"))


def vendor_aliases(vendor: DataFrame, actors: DataFrame) -> DataFrame:
    """group_id, actor, how: a vendor's groups(group_id, code, name) by the catalogue's code, else by a distinctive name (two
    words or six letters) that one actor has. actors has actor, code, name. A synonym of two groups ties neither."""
    key = name_key(F.col("name"))
    by_code = vendor.filter("code is not null").join(actors.filter("code is not null").select("actor", "code").distinct(), "code").select("group_id", "actor", F.lit("code").alias("how"))
    v = vendor.select("group_id", key.alias("key")).distinct().withColumn("groups", F.count("*").over(Window.partitionBy("key"))).filter("groups = 1")
    a = actors.select("actor", key.alias("key")).distinct().withColumn("owners", F.count("*").over(Window.partitionBy("key"))).filter("owners = 1")
    distinctive = F.col("key").contains(" ") | (F.length("key") >= 6)
    by_name = v.filter(distinctive).join(a, "key").select("group_id", "actor").distinct()
    one = by_name.groupBy("group_id").agg(F.min("actor").alias("actor"), F.count("*").alias("k")).filter("k = 1").select("group_id", "actor", F.lit("name").alias("how"))
    return by_code.dropDuplicates(["group_id"]).unionByName(one.join(by_code.select("group_id"), "group_id", "left_anti"))


def narrative_names(sentences: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """sentence_id, at, key, actor: names(name, actor) in sentences(sentence_id, text), the longest n-gram at each place first;
    one that several actors have is found but names nobody (actor null); a single word counts only if it is capitalised."""
    key = name_key(F.col("name"))
    table = names.select(key.alias("key"), "actor").distinct().groupBy("key").agg(F.min("actor").alias("actor"), F.count("*").alias("k")).select("key", F.when(F.col("k") == 1, F.col("actor")).alias("actor"), F.size(F.split("key", " ")).alias("n"))
    words = sentences.select("sentence_id", F.array_remove(F.split("text", TOKEN_GAP), "").alias("w"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w"))), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct((i - 1).alias("at"), n.alias("n"), F.slice("w", i, n).alias("g")))))
    placed = words.filter(F.size("w") > 0).select("sentence_id", F.explode(grams).alias("x"))
    asked = placed.select("sentence_id", F.col("x.at").alias("at"), F.col("x.n").alias("len"), F.lower(F.array_join("x.g", " ")).alias("key"), (F.col("x.n") > 1).alias("several"), F.col("x.g")[0].rlike(r"^\p{Lu}").alias("capital")).filter("several or capital")
    hits = asked.join(table.drop("n"), "key")
    per = hits.groupBy("sentence_id").agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("len")).alias("m"), "key", "actor"))).alias("h"))
    zero = F.struct(F.lit(0).alias("end"), F.slice("h", 1, 0).alias("kept"))
    kept = F.aggregate("h", zero, lambda s, h: F.when(h["at"] >= s["end"], F.struct((h["at"] - h["m"]).alias("end"), F.concat(s["kept"], F.array(h)).alias("kept"))).otherwise(s), lambda s: s["kept"])
    return per.select("sentence_id", F.explode(kept).alias("x")).select("sentence_id", "x.at", "x.key", "x.actor")


def wanted_actors(notices: DataFrame, actors: DataFrame) -> DataFrame:
    """notice, actor: wanted persons(notice, name) with the actors(actor, name, kind) of the longest shared name, if one only has
    it; two words at least."""
    key = name_key(F.col("name"))
    n = notices.select("notice", key.alias("key"))
    a = actors.filter("kind = 'person'").select("actor", key.alias("key")).distinct().withColumn("owners", F.count("*").over(Window.partitionBy("key"))).filter(F.col("key").contains(" "))
    hits = n.join(a, "key").withColumn("len", F.length("key"))
    best = hits.groupBy("notice").agg(F.max(F.struct("len", (-F.col("owners")).alias("o"), "actor")).alias("x"))
    return best.filter("x.o = -1").select("notice", "x.actor")


def top_connections(links: DataFrame, k: int = 25) -> DataFrame:
    """actor, rel, other, rank: the k most notable ends of each relation of an actor. links has actor, rel, other, notability."""
    w = Window.partitionBy("actor", "rel").orderBy(F.desc("notability"), "other")
    return links.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("actor", "rel", "other", "rank")


def review_summary(verdicts: DataFrame, names: DataFrame, enough: int = 5) -> DataFrame:
    """name, judged, right, precision, done, hits: verdicts(name, doc_id, right) beside the names(name, hits) that they judge."""
    per = verdicts.groupBy("name").agg(F.count("*").alias("judged"), F.count_if("right").alias("right"))
    joined = names.join(per, "name", "left").na.fill(0, ["judged", "right"])
    return joined.select("name", "judged", "right", F.when(F.col("judged") > 0, F.round(F.col("right") / F.col("judged"), 4)).alias("precision"), (F.col("judged") >= enough).alias("done"), "hits")
