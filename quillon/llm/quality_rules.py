"""Quality rules whose cutoffs carry a guarantee on false rejections, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.storage import materialize, table, unused

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Of a stratum's good documents, at most ALPHA are rejected by the learnt cutoffs; this holds with probability 1 - DELTA.
ALPHA, DELTA = 0.05, 0.05
#: Signals by name: lowest cutoff, step and number of cutoffs. A document is rejected above a cutoff.
SIGNALS = {
    "symbols": (0.02, 0.02, 50),  # symbols a word
    "uppercase": (0.02, 0.02, 50),  # upper-case letters a word character
    "marks": (0.02, 0.02, 50),  # characters that are neither letters nor digits, a word character
    "digits": (0.02, 0.02, 50),  # digits a word character
    "duplicate_lines": (0.02, 0.02, 50),  # lines equal to an earlier line, a line with a word
    "repeats": (0.02, 0.01, 50),  # words in repeated 3-word windows, a word
    "long_words": (4.0, 0.25, 80),  # characters a word
    "short_words": (0.10, 0.02, 45),  # words a character
}


def text_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the counts behind the other signals.

    All work is within the row. Repeated windows are found by sorting the document's own 3-word windows and comparing
    neighbours, so nothing is shuffled and a long document costs n log n. A null text counts as empty.
    Columns of docs that have the name of a count are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    rest = F.regexp_replace(text, r"[\p{Ll}\p{Lo}\p{Lm}\p{M}\x20\x09-\x0D]+", "")  # the few characters that the signals count
    split = docs.withColumns({
        "__words": F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>")),
        "__lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "__rest": rest,
    })
    n, rest = F.size("__words"), F.col("__rest")
    windows = F.arrays_zip("__words", F.slice("__words", F.lit(2), n), F.slice("__words", F.lit(3), n), F.sequence(F.lit(0), n - 1))
    split = split.withColumn("__sorted", F.when(n >= 4, F.sort_array(F.slice(windows, F.lit(1), n - 2))))

    def same(x: Column) -> Column:
        a, b = x["__sorted"], x["1"]
        return (a["2"] == b["2"]) & (a["1"] == b["1"]) & (a["__words"] == b["__words"])  # neighbours differ at the end first

    pairs = F.filter(F.arrays_zip("__sorted", F.slice("__sorted", F.lit(2), n)), same)
    starts = F.flatten(F.transform(pairs, lambda x: F.array(x["__sorted"]["3"], x["1"]["3"])))
    covered = F.flatten(F.transform(starts, lambda s: F.array(s, s + 1, s + 2)))
    return split.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": (F.length(rest) - F.length(F.regexp_replace(rest, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long"),
        "__n_lines": F.size("__lines"),
        "__n_upper": F.length(rest) - F.length(F.regexp_replace(rest, r"\p{Lu}+", "")),
        "__n_digits": F.length(rest) - F.length(F.regexp_replace(rest, r"\p{Nd}+", "")),
        "__n_marks": F.length(F.regexp_replace(rest, r"[\p{Lu}\p{N}]+", "")),
    }).drop("__words", "__lines", "__sorted", "__rest")


def signal_bins() -> Column:
    """How many cutoffs of each signal the document is above, in the order of SIGNALS."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    value = {
        "symbols": F.col("n_symbols") / words,
        "uppercase": F.col("__n_upper") / chars,
        "marks": F.col("__n_marks") / chars,
        "digits": F.col("__n_digits") / chars,
        "duplicate_lines": F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
        "short_words": F.col("n_words") / chars,
    }
    return F.array(*[F.greatest(F.lit(0), F.least(F.lit(k), F.ceil((value[name] - low) / step))).cast("int") for name, (low, step, k) in SIGNALS.items()])


def allowed_rejections(n: Column, rate: float, error: Column) -> Column:
    """The most rejections k among n good documents for which the exact binomial test still rules out a rate above `rate`.

    That is the largest k with P(X <= k) <= error for X binomial(n, rate), -1 if there is none. The terms of the sum
    follow from one another, as logarithms, so a large n does not underflow.
    """
    odds = F.log(F.lit(rate / (1 - rate)))
    start = F.struct((n * F.log(F.lit(1 - rate))).alias("term"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"))

    def step(s: Column, i: Column) -> Column:
        total = s["sum"] + F.exp(s["term"])
        return F.struct((s["term"] + F.log((n - i) / (i + 1)) + odds).alias("term"), total.alias("sum"), F.when(total <= error, i.cast("long")).otherwise(s["k"]).alias("k"))

    upto = F.sequence(F.lit(0).cast("long"), F.floor(n * F.lit(rate)))
    return F.aggregate(upto, start, step, lambda s: s["k"])


def learn_cutoffs(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row for each stratum: __stratum, __cutoffs (map from a signal's position to the bin that is rejected from).

    The labelled documents (quality 1: good, 0: bad) are the holdout; the cutoffs to choose from are fixed beforehand.
    Each signal of each stratum may falsely reject alpha / signals, tested with the exact binomial tail at
    delta / (signals * strata) (Bonferroni). Within a signal, cutoffs are tried from the mildest on; false rejections
    only grow on that way, so the sequence needs no further correction. All cutoffs that pass hold at the same
    time, hence the choice among them is free: it is the mildest of those with the most bad documents rejected, less the
    good ones. A stratum with too few labels gets no cutoffs. Documents are counted by bins before anything is gathered.
    """
    k = len(SIGNALS)
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__quality"))
    held = counted.join(known, F.col("doc_id") == F.col("__id")).select("__stratum", "__quality", F.posexplode("__bins").alias("__signal", "__bin"))
    good, bad = (F.sum((F.col("__quality") == q).cast("long")) for q in (1, 0))
    bins = held.groupBy("__stratum", "__signal", "__bin").agg(good.alias("__good"), bad.alias("__bad"))
    above = Window.partitionBy("__stratum", "__signal").orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("__stratum", "__signal")
    bins = bins.withColumns({"__n": F.sum("__good").over(whole), "__false": F.sum("__good").over(above), "__true": F.sum("__bad").over(above)})
    strata = bins.groupBy("__stratum").agg(F.max("__n").alias("__n_good"))
    m = strata.agg((F.count("*") * k).alias("__tests"))
    limits = strata.join(F.broadcast(m)).select(F.col("__stratum").alias("__s"), F.when(F.col("__n_good") > 0, allowed_rejections(F.col("__n_good"), alpha / k, F.lit(delta) / F.col("__tests"))).otherwise(F.lit(-1)).alias("__allowed"))
    passed = bins.filter("__bin > 0").join(limits, F.col("__stratum").eqNullSafe(F.col("__s"))).filter("__false <= __allowed and __true > __false")
    best = passed.groupBy("__stratum", "__signal").agg(F.max(F.struct(F.col("__true") - F.col("__false"), F.col("__bin").alias("bin"))).alias("__best"))
    return best.groupBy(F.col("__stratum").alias("__of")).agg(F.map_from_entries(F.collect_list(F.struct("__signal", "__best.bin"))).alias("__cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row for each document: doc_id, the base counts, base_failed, kept and rejected_by (names of signals).

    docs needs doc_id, text and lang (the stratum; null is one of its own); any may be null and other columns are
    ignored. labels needs doc_id and quality; of several labels of a document the lowest counts, others than 0 and 1 do
    not. An empty text has 0 words and fails. Rows with the same doc_id are judged alike by their own text.
    """
    plain = docs.select("doc_id", F.when(F.col("lang").isNull(), "null").otherwise(F.concat(F.lit("="), "lang")).alias("__stratum"), "text")
    counted = text_counts(plain).withColumn("__bins", signal_bins())
    counted = materialize(counted.select("doc_id", "__stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "__bins"), "rule-counts")
    cutoffs = learn_cutoffs(counted, labels, alpha, delta)
    judged = counted.join(cutoffs, F.col("__stratum") == F.col("__of"), "left")
    hits = [F.when(F.col("__bins")[i] >= F.col("__cutoffs")[F.lit(i)], F.lit(name)) for i, name in enumerate(SIGNALS)]
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = judged.withColumn("rejected_by", F.array_compact(F.array(*hits))).withColumn("base_failed", base_failed)
    kept = ~F.col("base_failed") & (F.size("rejected_by") == 0)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rejected_by")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns.

    The verdict of a document is taken by doc_id. Of rows that share one, each goes by the verdict that all of them
    get: the document stays if any of its rows is kept. A row without doc_id goes by the verdict of the rows without.
    """
    of = unused(docs, "__verdict_id")
    verdicts = judge(docs, labels, alpha, delta).groupBy(F.col("doc_id").alias(of)).agg(F.max("kept").alias("__kept"))
    kept = verdicts.filter("__kept").select(of)
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col(of)), "left_semi")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.withColumn("rejected_by", F.array_join("rejected_by", ","))
