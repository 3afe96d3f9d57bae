"""Scalar rules: folding, addresses, years, identifiers, partial dates. Columns where Catalyst can say it, else vectorised
Python over distinct values."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters that decomposition leaves alone.
_SPECIAL = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "­": ""})


def fold_text(text: str) -> str:
    """Lower case without diacritics."""
    plain = unicodedata.normalize("NFKD", text.lower().translate(_SPECIAL))
    return "".join(c for c in plain if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fold_text(x))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def domain_family(url: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host(url), ".", -2)


def address_norm(url: Column) -> Column:
    """Host without www. and path in lower case, without query, fragment and closing slashes."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    return F.concat(host(url), F.regexp_replace(F.lower(path), "/+$", ""))


def folder(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/[^/]*$", "")


def address_langs(url: Column) -> Column:
    """Language markers of an address, sorted."""
    parts = F.split(F.lower(F.regexp_replace(url, r"^[A-Za-z]+://[^/]+", "")), r"[^a-z]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.isin("en", "de", "fr", "es", "it", "cs", "pl"))))


def address_key(url: Column) -> Column:
    """An address without its language markers: the same for a document's language versions."""
    return F.regexp_replace(address_norm(url), r"(?<=[/_.-])(?:en|de|fr|es|it|cs|pl)(?=[/_.-]|$)", "*")


def series_key(title: Column) -> Column:
    """A title without years, numbers and filler words: equal for the editions of a series."""
    words = F.split(F.regexp_replace(F.lower(title), r"[^\p{L}]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (F.length(w) > 0) & ~w.isin("annual", "report", "the", "of", "for", "and", "year")), " ")


def guess_year(title: Column, url: Column, last: int) -> Column:
    """The greatest year from 1990 to `last` in the title, else in the address."""
    def years(s: Column) -> Column:
        return F.array_max(F.filter(F.transform(F.regexp_extract_all(s, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(1990, last)))

    return F.coalesce(years(F.coalesce(title, F.lit(""))), years(F.coalesce(url, F.lit(""))))


# First years of the eras less one.
ERAS = {"reiwa": 2018, "heisei": 1988, "showa": 1925}


def era_year(text: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, base in ERAS.items():
        n = F.regexp_extract(F.lower(text), rf"{name} ([0-9]{{1,2}})", 1)
        out = F.coalesce(out, F.when(n != "", n.cast("int") + base))
    return out


def partial_date(text: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD to a fractional year."""
    p = F.split(text, "-")
    month, day = (F.coalesce(F.get(p, F.lit(i)).cast("double"), F.lit(1.0)) for i in (1, 2))
    return F.round(p[0].cast("double") + (month - 1) / 12 + (day - 1) / 365, 6)


def page_of(offsets: Column, place: Column) -> Column:
    """The page, from 1, that a place lies on."""
    return F.size(F.filter(offsets, lambda o: o <= place))


def isbn_ok(value: Column) -> Column:
    """Whether ten or thirteen digits have a right check digit."""
    s = F.upper(F.regexp_replace(value, "[^0-9Xx]", ""))
    digits = F.transform(F.split(s, ""), lambda c: F.when(c == "X", 10).otherwise(c.cast("int")))
    ten = F.aggregate(F.transform(digits, lambda d, i: d * (10 - i)), F.lit(0), lambda a, b: a + b) % 11 == 0
    thirteen = F.aggregate(F.transform(digits, lambda d, i: d * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, b: a + b) % 10 == 0
    return F.when(s.rlike("^[0-9]{9}[0-9X]$"), ten).when(s.rlike("^[0-9]{13}$"), thirteen).otherwise(F.lit(False))


def cves(text: Column, last: int) -> Column:
    """CVE numbers of a text, upper case, hyphens unified, years from 1999 to last."""
    found = F.transform(F.regexp_extract_all(F.upper(text), F.lit(r"CVE[-‐‑‒–—]([0-9]{4}[-‐‑‒–—][0-9]{4,7})"), F.lit(1)), lambda x: F.concat(F.lit("CVE-"), F.regexp_replace(x, "[‐‑‒–—]", "-")))
    return F.array_distinct(F.filter(found, lambda c: F.substring(c, 5, 4).cast("int").between(1999, last)))


def techniques(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(T1[0-9]{3}(?:\.[0-9]{3})?)\b"), F.lit(1)))


def script_share(text: Column, pattern: str) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.when(letters > 0, F.round(F.length(F.regexp_replace(text, rf"[^{pattern}]+", "")) / letters, 6)).otherwise(F.lit(0.0))


# Scripts by their code points, in the order in which they are asked.
SCRIPTS = [("arabic", r"\u0600-\u06FF"), ("cyrillic", r"\u0400-\u04FF"), ("greek", r"\u0370-\u03FF"), ("hebrew", r"\u0590-\u05FF"), ("kana", r"\u3040-\u30FF"), ("hangul", r"\uAC00-\uD7AF"), ("han", r"\u3400-\u9FFF"), ("latin", r"A-Za-z\u00C0-\u024F")]


def script_of(text: Column, least: float = 0.3) -> Column:
    """The first script that `least` of a text's letters are written in; null without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    out = F.lit(None).cast("string")
    for name, span in reversed(SCRIPTS):
        out = F.when(F.length(F.regexp_replace(text, f"[^{span}]+", "")) >= least * letters, name).otherwise(out)
    return F.when(letters > 0, out)


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def dice(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.round(2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)), 6)


def roman(text: str) -> int | None:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    if not re.fullmatch(r"m*(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})", text.lower()) or not text:
        return None
    total = 0
    for c, after in zip(text.lower(), [*text.lower()[1:], ""], strict=True):
        total += -values[c] if after and values[after] > values[c] else values[c]
    return total


def sentences(text: Column) -> Column:
    """Sentences: pieces that end in a full stop, question or exclamation mark before white space, or at a line end."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
