"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.storage import table, unused

#: Kinds in their order: pattern and the least length of the part that counts (group 2 for assign, else the match).
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_ASSIGN = 6
# greedy runs, so asking for the length in the pattern gives the same matches as dropping short ones afterwards
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
WINDOW = 20
#: Character classes of the entropy scan: candidate strings and the bits a character from which a window is hot.
CLASSES = {
    "entropy_hex": (r"[0-9A-Fa-f]{20,}", 3.0),
    "entropy_token": (r"[A-Za-z0-9+/_=-]{20,}", 3.9),
}
#: Candidates that match one of these are no secrets: digits alone, words joined by marks, placeholders, UUIDs in nil form, addresses.
ALLOW = (
    r"^[0-9]+$",
    r"^[A-Za-z]?[a-z]*(?:[/_=+-][A-Za-z]?[a-z]*)*$",
    r"(?i)example|placeholder|changeme|your[_-]|xxxx|abcdefghij|0123456789",
    r"^(?:[A-Za-z]{1,9}:)?//",
)
KINDS = (*BASE, *CLASSES)


def _split_at(text: Column, pattern: str) -> tuple[Column, Column]:
    """The leftmost non-overlapping matches and the pieces between them; split and match walk the text alike."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, however often body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


#: Items that running() handles at a time: it appends to arrays, which copies them, so long ones are built of blocks.
BLOCK = 128


def running(items: Column, zero: Column, step) -> Column:
    """The state after each item, like a prefix sum: step(state, item) -> state, in order.

    States of a block are appended to a short array, and blocks to an array of blocks. That is near linear work where
    appending to one array is quadratic.
    """

    def whole(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / BLOCK).cast("int") - 1), lambda i: F.slice(xs, i * BLOCK + 1, F.lit(BLOCK)))
        none = F.slice(F.array(zero), F.lit(1), F.lit(0))

        def item(s: Column, x: Column) -> Column:
            return let(step(s["last"], x), lambda now: F.struct(now.alias("last"), F.concat(s["out"], F.array(now)).alias("out")))

        def block(s: Column, xs: Column) -> Column:
            done = F.aggregate(xs, F.struct(s["last"].alias("last"), none.alias("out")), item)
            return let(done, lambda d: F.struct(d["last"].alias("last"), F.concat(s["out"], F.array(d["out"])).alias("out")))

        every = F.aggregate(blocks, F.struct(zero.alias("last"), F.slice(F.array(none), F.lit(1), F.lit(0)).alias("out")), block, lambda s: F.flatten(s["out"]))
        return F.when(F.size(xs) > 0, every).otherwise(none)

    return let(items, whole)


def located(text: Column, pattern: str) -> Column:
    """Matches as an array of structs m, start (code points), in order.

    Spark gives no offsets of matches, so they follow from the lengths of the pieces between and of the matches before.
    The text is split only where there is a match.
    """
    found, pieces = _split_at(text, pattern)
    zero = F.struct(F.lit("").alias("m"), F.lit(0).alias("start"), F.lit(0).alias("end"))

    def step(s: Column, x: Column) -> Column:
        start = s["end"] + F.length(x["piece"])
        return F.struct(x["m"].alias("m"), start.alias("start"), (start + F.length(x["m"])).alias("end"))

    none = F.slice(F.array(zero), F.lit(1), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, running(F.arrays_zip(F.slice(pieces, F.lit(1), F.size(m)).alias("piece"), m.alias("m")), zero, step)).otherwise(none))


def _spans(found: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("kind"), x["end"].alias("end")))


#: Entropy in whole numbers, so that sums never drift: n log2 n in units of 2**-32.
UNIT = 1 << 32
#: Counts of characters, five bits each and twelve to a number, by code point up to 127.
_BITS, _EACH = 5, 12


def hot_runs(candidate: Column, start: Column, bits: float, kind: int, window: int = WINDOW) -> Column:
    """Spans of merged windows of a candidate string that hold `bits` a character or more.

    A window's entropy is log2(window) - S / window with S the sum of c log2 c over its characters' counts. The state
    holds S and the counts themselves; when the window moves on, the counts of the entering and of the leaving
    character change by one, and S by the two differences. Windows have at most 31 characters, candidates are ASCII.
    """
    weights = F.array(*[F.lit(round(n * math.log2(n) * UNIT) if n > 1 else 0).cast("long") for n in range(window + 1)])
    most = math.floor((math.log2(window) - bits) * window * UNIT + 1e-3)  # S of a window that is just hot
    words = -(-128 // _EACH)
    span = "struct<start:int,kind:int,end:int>"
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.array().cast(f"array<{span}>").alias("runs"))

    def count(counts: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.element_at(counts, (code / _EACH).cast("int") + 1), (code % _EACH * _BITS).cast("int")).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

    def change(code: Column, k: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (code % _EACH * _BITS).cast("int"))
        return F.when((code / _EACH).cast("int") == k, one).otherwise(F.lit(0).cast("long"))

    def weight(n: Column) -> Column:
        return F.element_at(weights, n + 1)

    def scanned(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            entering = F.element_at(codes, i)
            leaving = F.when(i > window, F.element_at(codes, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(words * _EACH))
            n_in, n_out = count(state["counts"], entering), F.when(i > window, count(state["counts"], leaving)).otherwise(F.lit(1))
            s = F.when(leaving == entering, state["s"]).otherwise(state["s"] + weight(n_in + 1) - weight(n_in) - weight(n_out) + weight(n_out - 1))
            counts = F.when(leaving == entering, state["counts"]).otherwise(F.transform(state["counts"], lambda w, k: w + change(entering, k) - change(leaving, k)))
            now = F.struct((start + i - window).alias("start"), F.lit(kind).alias("kind"), (start + i).alias("end"))
            last = F.element_at(state["runs"], -1)
            joins = (F.size(state["runs"]) > 0) & (F.when(F.size(state["runs"]) > 0, last["end"]) >= now["start"])
            grown = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), now["end"].alias("end"))
            runs = F.when(~((i >= window) & (s <= most)), state["runs"]).when(joins, F.concat(F.slice(state["runs"], F.lit(1), F.size(state["runs"]) - 1), F.array(grown))).otherwise(F.concat(state["runs"], F.array(now)))
            return F.struct(s.alias("s"), counts.alias("counts"), runs.alias("runs"))

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, lambda s: s["runs"])

    return let(F.transform(F.split(candidate, ""), F.ascii), scanned)


def entropy_spans(text: Column, kind: str, allow: tuple[str, ...] = ALLOW) -> Column:
    pattern, bits = CLASSES[kind]
    suspicious = F.filter(located(text, pattern), lambda x: ~F.greatest(*[x["m"].rlike(a) for a in allow]) if len(allow) > 1 else ~x["m"].rlike(allow[0]))
    return F.flatten(F.transform(suspicious, lambda x: hot_runs(x["m"], x["start"], bits, KINDS.index(kind))))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, sorted by start, then kind."""
    assign = F.filter(located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= MIN_ASSIGN)
    return F.sort_array(F.concat(_spans(assign, "assign"), _spans(located(text, ACCESS), "access"), _spans(located(text, HEX), "hex")))


def scan(docs: DataFrame, base: str, every: str, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs with the columns `base` and `every`: arrays of structs start, kind (position in KINDS), end, sorted by start,
    then kind.

    docs needs text (null counts as empty). Everything is within the row: no shuffle, no group. Spans are in code
    points, end exclusive. Repeated rows are scanned alike.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    added = F.concat(*[entropy_spans(text, kind, allow) for kind in CLASSES])
    return docs.withColumn(base, base_spans(text)).withColumn(every, F.sort_array(F.concat(F.col(base), added)))


def _number(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans. doc_id and text may be null."""
    found = scan(docs.select("doc_id", "text"), "__base", "__all", allow)
    counts = {f"n_{kind}": _number(F.col("__base"), i) for i, kind in enumerate(BASE)}
    found = found.withColumns(counts | {"base_sha256": F.sha2(written(F.col("__base")), 256), "spans": written(F.col("__all"))})
    return found.select("doc_id", *counts, "base_sha256", "spans")


#: Code points of a block that redact() cuts pieces from: cutting from the whole text would read it again for each.
CHARS = 4096


def _without(text: Column, spans: Column, mark: str) -> Column:
    """text with each run of overlapping spans (sorted) replaced by mark."""
    zero = F.struct(F.lit(0).alias("before"), F.lit(0).alias("start"), F.lit(0).alias("end"))

    def step(s: Column, x: Column) -> Column:
        return F.struct(s["end"].alias("before"), x["start"].alias("start"), F.greatest(s["end"], x["end"]).alias("end"))

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        first = (a / CHARS).cast("int")
        some = F.slice(blocks, first + 1, ((b - 1) / CHARS).cast("int") - first + 1)
        return F.when(b > a, F.substring(F.array_join(some, ""), a - first * CHARS + 1, b - a)).otherwise(F.lit(""))

    def cut(blocks: Column) -> Column:
        def whole(reach: Column) -> Column:
            begins = F.filter(reach, lambda r: (r["start"] >= r["before"]))
            parts = F.transform(begins, lambda r: F.concat(piece(blocks, r["before"], r["start"]), F.lit(mark)))
            return F.concat(F.array_join(parts, ""), piece(blocks, F.element_at(reach, -1)["end"], F.length(text)))

        return let(running(spans, zero, step), whole)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0)), cut)


def redact(docs: DataFrame, mark: str = "[SECRET]", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs with each secret in text replaced by mark; overlapping spans are one. n_chars, if there, is set anew for
    changed texts. Other columns, whatever their names, their order and the rows stay; a null text stays null."""
    base, every, clean = (unused(docs, f"__{name}") for name in ("base", "all", "clean"))
    found = scan(docs, base, every, allow)
    changed = F.size(every) > 0
    found = found.withColumn(clean, F.when(changed, _without(F.col("text"), F.col(every), mark)).otherwise(F.col("text")))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col(clean).alias(c))
        elif c == "n_chars":
            columns.append(F.when(changed, F.length(clean).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return found.select(*columns)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
