"""Years, types and languages of documents by cascades of rules, with the evidence beside each result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDER_LEAST, VERSIONS_LEAST = 3, 2


def first_rule(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, test in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def document_type(title: Column, pages: Column) -> Column:
    """Ordered rules on a folded title; an annual report has four pages at least."""
    t = F.lower(title)
    return first_rule([("press release", t.rlike(r"\bpress release\b|\bstatement\b")), ("annual report", t.rlike(r"\bannual\b|\byearbook\b") & (pages >= 4)), ("advisory", t.rlike(r"\badvisory\b|\bwarning\b|\balert\b")), ("law", t.rlike(r"\bact\b|\bregulation\b|\blaw\b")), ("report", t.rlike(r"\breport\b|\bassessment\b|\breview\b"))], "other")


def with_hand(found: DataFrame, hand: DataFrame, key: str, column: str) -> DataFrame:
    """found with verdicts by hand in place of the rules' results."""
    return found.join(hand.select(key, F.col(column).alias("__hand")), key, "left").withColumn(column, F.coalesce("__hand", column)).drop("__hand")


def _others(docs: DataFrame, keys: list[str], by: Column, kind: str, least: int) -> DataFrame:
    """The one year of the other dated documents with the same keys, if there are `least` of them; a document's own year
    doesn't speak for it, nor do years that this rule gave."""
    w = Window.partitionBy(*keys)
    own = F.when(by, F.col("year"))
    others = F.count(own).over(w) - by.cast("int")
    low = F.when(by, F.lit(None)).otherwise(F.min(own).over(w))
    agree = (F.min(own).over(w) == F.max(own).over(w)) & (others >= least)
    return docs.withColumn(kind, F.when(agree & low.isNotNull(), low))


def from_folder(docs: DataFrame, least: int = FOLDER_LEAST) -> DataFrame:
    """docs(doc_id, source, folder, year, kind) with folder_year for undated documents."""
    return _others(docs, ["source", "folder"], F.col("year").isNotNull() & (F.coalesce("kind", F.lit("")) != "folder"), "folder_year", least)


def from_versions(docs: DataFrame, least: int = VERSIONS_LEAST) -> DataFrame:
    """docs(doc_id, source, folder, title_key, lang, year) with versions_year: the other languages' year, if each file of the
    group has a language of its own."""
    keys = ["source", "folder", "title_key"]
    w = Window.partitionBy(*keys)
    distinct = F.size(F.collect_set("lang").over(w)) == F.count("*").over(w)
    return _others(docs, keys, F.col("year").isNotNull() & distinct, "versions_year", least)


def estimate(candidates: list[tuple[str, str]]) -> list[Column]:
    """year and evidence of the first candidate (evidence, column) with a year."""
    year = F.coalesce(*[F.col(c) for _, c in candidates])
    return [year.alias("year"), first_rule([(name, F.col(c).isNotNull()) for name, c in candidates]).alias("evidence")]


def conflicts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, stored, found: years of the text that contradict the stored one by more than the year of a stamp, but for
    those that a reviewer kept."""
    return docs.filter("year is not null and found is not null and found <> year and found <> year + 1").select("doc_id", F.col("year").alias("stored"), "found").join(kept.select("doc_id"), "doc_id", "left_anti")


def accuracy(docs: DataFrame) -> DataFrame:
    """evidence, n, exact, near of docs(evidence, year, truth)."""
    return docs.filter("year is not null and truth is not null").groupBy("evidence").agg(F.count("*").alias("n"), F.count_if(F.col("year") == F.col("truth")).alias("exact"), F.count_if(F.abs(F.col("year") - F.col("truth")) <= 1).alias("near"))


def retag(docs: DataFrame, guesses: DataFrame, strong: float = 0.05, weak: float = 0.15) -> DataFrame:
    """doc_id, lang: documents whose text is clearly in another language: `strong` of the words, and the stored language's
    share `weak` of that at most. guesses has doc_id, guess, share."""
    best = guesses.groupBy("doc_id").agg(F.max_by("guess", F.struct("share", "guess")).alias("best"), F.max("share").alias("top"))
    own = guesses.select("doc_id", F.col("guess").alias("lang"), F.col("share").alias("own"))
    return docs.select("doc_id", "lang").join(best, "doc_id").join(own, ["doc_id", "lang"], "left").filter((F.col("best") != F.col("lang")) & (F.col("top") >= strong) & (F.coalesce("own", F.lit(0.0)) <= weak * F.col("top"))).select("doc_id", F.col("best").alias("lang"))
