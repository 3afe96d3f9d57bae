"""The filter algebra: optional parameters become one conjunction over the scope, and a console line becomes parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    lang: str | None = None
    country: str | None = None
    coalition: tuple[str, ...] | None = None
    publisher: str | None = None
    source: str | None = None
    doc_type: str | None = None
    year: int | None = None
    year_from: int | None = None
    year_to: int | None = None
    undated: bool = False
    added_from: str | None = None
    added_to: str | None = None
    topics: tuple[str, ...] = ()
    main_topic: bool = False
    words: tuple[str, ...] = ()


_EQUAL = ("lang", "country", "publisher", "source", "doc_type", "year")


def apply(docs: DataFrame, f: Filters, topics: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """docs under f. Columns compare, days are ranges, topics and words are semi-joins; nothing is collected."""
    for name in _EQUAL:
        if getattr(f, name) is not None:
            docs = docs.filter(F.col(name) == getattr(f, name))
    if f.coalition:
        docs = docs.filter(F.col("country").isin(*f.coalition))
    if f.undated:
        docs = docs.filter(F.col("year").isNull())
    for name, test in (("year_from", F.col("year") >= f.year_from), ("year_to", F.col("year") <= f.year_to), ("added_from", F.col("added") >= F.lit(f.added_from).cast("date")), ("added_to", F.col("added") <= F.lit(f.added_to).cast("date"))):
        if getattr(f, name) is not None:
            docs = docs.filter(test)
    for topic in f.topics:
        chosen = topics.filter((F.col("topic") == topic) & (F.col("rank") <= 3 if f.main_topic else F.lit(True)))
        docs = docs.join(chosen.select("doc_id"), "doc_id", "left_semi")
    for word in f.words:
        match = F.col("token").startswith(word[:-1]) if word.endswith("*") else F.col("token") == word
        docs = docs.join(tokens.filter(match).select("doc_id"), "doc_id", "left_semi")
    return docs


_PART = re.compile(r'(?:([a-z]+):)?(?:"([^"]*)"|(\S+))')
_RANGE = re.compile(r"^(\d{4})?\.\.(\d{4})?$")


def parse_console(line: str) -> tuple[Filters, list[str]]:
    """`op:value` words, quoted values and year ranges to filters, with the parts that weren't understood."""
    known, f, problems = {x.name for x in fields(Filters)}, Filters(), []
    for m in _PART.finditer(line):
        name, value = m[1], m[2] if m[2] is not None else m[3]
        if name is None:
            f = replace(f, words=(*f.words, value.lower()))
        elif name == "topic":
            f = replace(f, topics=(*f.topics, value))
        elif name == "type":
            f = replace(f, doc_type=value)
        elif name == "year" and value == "none":
            f = replace(f, undated=True)
        elif name == "year" and (r := _RANGE.match(value)) and (r[1] or r[2]):
            f = replace(f, year_from=int(r[1]) if r[1] else None, year_to=int(r[2]) if r[2] else None)
        elif name == "year" and value.isdigit():
            f = replace(f, year=int(value))
        elif name in known and name not in ("year", "words", "topics", "undated", "main_topic", "coalition"):
            f = replace(f, **{name: value})
        else:
            problems.append(m[0])
    return f, problems


def to_console(f: Filters) -> str | None:
    """The console line that parse_console reads back as f, if there is one."""
    parts = [f"{n}:{_quoted(getattr(f, n))}" for n in ("lang", "country", "publisher", "source", "added_from", "added_to") if getattr(f, n) is not None]
    parts += [f"type:{_quoted(t)}" for t in [f.doc_type] if t is not None] + [f"topic:{_quoted(t)}" for t in f.topics] + [_quoted(w) for w in f.words]
    parts += [f"year:{f.year}"] * (f.year is not None) + ["year:none"] * f.undated
    if f.year_from is not None or f.year_to is not None:
        parts.append(f"year:{f.year_from or ''}..{f.year_to or ''}")
    line = " ".join(parts)
    return line if parse_console(line) == (f, []) else None


def _quoted(value: str) -> str:
    return f'"{value}"' if re.search(r"\s", value) else value


def page(docs: DataFrame, order, number: int, size: int = 50) -> DataFrame:
    """The rows of a page, from 1, in a total order; a page beyond the last one is the last one."""
    last = max(1, -(-docs.count() // size)) if number > 1 else 1
    return docs.orderBy(*order).offset((min(max(number, 1), last) - 1) * size).limit(size)
