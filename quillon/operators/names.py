"""Names: preparation of a gazetteer, matching, corpus-wide rules, suggestions and identity across lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import dice
from quillon.operators.relational import band_pairs
from quillon.sources.library import TOKEN_GAP

WINDOW = 600
#: Names that match() sends to every task.
MOST_NAMES = 500_000


def prepare(names: DataFrame, generic: list[str]) -> DataFrame:
    """names(actor, name) with status and reason: short, generic and shared names are rejected, in this order."""
    n = F.lower(F.trim("name"))
    owners = names.select(n.alias("k"), "actor").distinct().groupBy("k").agg(F.count("*").alias("owners"))
    joined = names.withColumn("k", n).dropDuplicates(["actor", "k"]).join(owners, "k")
    reason = F.when(F.length("k") < 3, "too short").when(F.col("k").isin(*generic), "generic").when(F.col("owners") > 1, "shared")
    return joined.select("actor", "name", F.when(reason.isNull(), "used").otherwise("rejected").alias("status"), F.coalesce(reason, F.lit("")).alias("reason"))


def match(docs: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, actor, name, start, end (characters): case-sensitive token sequences, the longest at each place.

    The gazetteer, a file of at most MOST_NAMES names, which is checked, is sent as first token -> sequences; a document is
    read once, left to right. matching.found joins gazetteers of any size.
    """
    table: dict[str, list[tuple[list[str], str, str]]] = {}
    rows = names.select("actor", "name").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names to send: use matching.found")
    for r in rows:
        words = r["name"].split()
        if words:
            table.setdefault(words[0], []).append((words, r["actor"], r["name"]))
    for found in table.values():
        found.sort(key=lambda x: (-len(x[0]), x[2], x[1]))
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        import re

        import pandas as pd

        word = re.compile(r"\w+")
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                marks = [(m.group(), m.start(), m.end()) for m in word.finditer(text or "")]
                i = 0
                while i < len(marks):
                    step = 1
                    for words, actor, name in sent.value.get(marks[i][0], ()):
                        if [m[0] for m in marks[i : i + len(words)]] == words:
                            rows.append((doc_id, actor, name, marks[i][1], marks[i + len(words) - 1][2]))
                            step = len(words)
                            break
                    i += step
            yield pd.DataFrame(rows, columns=["doc_id", "actor", "name", "start", "end"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, actor string, name string, start long, end long")


def capitalised_uses(docs: DataFrame, names: DataFrame) -> DataFrame:
    """name, upper, lower: how often one-word names occur as written and in lower case, over the whole corpus. A name is an
    ordinary word, and dropped, where lower > upper."""
    single = names.select("name").distinct().filter(~F.col("name").contains(" "))
    words = docs.select(F.explode(F.array_remove(F.split("text", TOKEN_GAP), "")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    upper = words.join(single, F.col("w") == F.col("name")).groupBy("name").agg(F.sum("n").alias("upper"))
    lower = words.join(single.withColumn("l", F.lower("name")), F.col("w") == F.col("l")).groupBy("name").agg(F.sum("n").alias("lower"))
    return single.join(upper, "name", "left").join(lower, "name", "left").select("name", F.coalesce("upper", F.lit(0)).alias("upper"), F.coalesce("lower", F.lit(0)).alias("lower"))


def mentions(hits: DataFrame, weak: DataFrame, ordinary: DataFrame) -> DataFrame:
    """doc_id, actor, hits, names: hits without ordinary words; one weak name alone in a document doesn't count."""
    kept = hits.join(ordinary.filter("lower > upper").select("name"), "name", "left_anti").join(weak.select("name", F.lit(True).alias("weak")), "name", "left")
    per = kept.groupBy("doc_id", "actor").agg(F.count("*").alias("hits"), F.count_distinct("name").alias("names"), F.max(~F.coalesce("weak", F.lit(False))).alias("strong"))
    return per.filter("strong or names > 1").select("doc_id", "actor", "hits", "names")


def pairs(hits: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, a, b, n: actors named within `width` characters of each other."""
    return band_pairs(hits, "doc_id", "start", "actor", width)


def suggest(names: DataFrame, asked: str, k: int = 12) -> DataFrame:
    """name, points: exact 100, beginning 90, beginning of a word 80, similar 40 + 40 * dice from 0.6; more for names in
    many documents. names has name and docs."""
    q, n = asked.lower(), F.lower("name")
    similar = dice(F.col("name"), F.lit(asked))
    points = F.when(n == q, 100.0).when(n.startswith(q), 90.0).when(n.contains(f" {q}"), 80.0).when(similar >= 0.6, 40 + 40 * similar)
    return names.withColumn("points", F.round(points + 4 * F.log10(1 + F.col("docs")), 4)).filter("points is not null").orderBy(F.desc("points"), "name").limit(k).select("name", "points")


def match_unique(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """left_id, right_id by equal names (case, marks and spacing aside) that one row of each side has."""
    k = F.array_join(F.array_remove(F.split(F.lower(name), TOKEN_GAP), ""), " ")
    sides = []
    for df, i in ((left, "left_id"), (right, "right_id")):
        own = df.select(F.col("id").alias(i), k.alias("k")).distinct()
        sides.append(own.withColumn("owners", F.count("*").over(Window.partitionBy("k"))).filter("owners = 1 and k <> ''").drop("owners"))
    return sides[0].join(sides[1], "k").select("left_id", "right_id")
