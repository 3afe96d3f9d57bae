"""Rules on names, titles, dates, identifiers and passages, as column expressions; Unicode folding as vectorised Python."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from quillon.functions.scalar import _SPECIAL, host

# Month names by their first three letters, in order.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_UPPER = {ord(chr(k).upper()): v.capitalize() if v.isalpha() else v for k, v in _SPECIAL.items() if len(chr(k).upper()) == 1}


def _stripped(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def fold_kept(s: pd.Series) -> pd.Series:
    """Without diacritics, capitals kept."""
    return s.map(lambda x: None if x is None else _stripped(x.translate(_SPECIAL).translate(_UPPER)))


@F.pandas_udf(StringType())
def name_norm(s: pd.Series) -> pd.Series:
    """A register's name: words without diacritics and case, one space between."""
    return s.map(lambda x: None if x is None else " ".join(re.findall(r"\w+", _stripped(x).casefold())))


@F.pandas_udf(StringType())
def quote_norm(s: pd.Series) -> pd.Series:
    """A quotation: character references resolved, compatible forms, quotes and dashes unified, no case."""
    table = str.maketrans({"“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "\xa0": " "})
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", html.unescape(x)).translate(table).casefold().split()))


@F.pandas_udf(ArrayType(IntegerType()))
def kept_places(s: pd.Series) -> pd.Series:
    """The places of the characters that folding white space to single blanks keeps: offsets back into the original."""
    return s.map(lambda x: None if x is None else [i for i, c in enumerate(x) if not c.isspace() or (i > 0 and not x[i - 1].isspace())])


# Function words whose share tells English.
ENGLISH = ["the", "of", "and", "to", "in", "that", "is", "for", "on", "with", "as", "by", "at", "from", "this"]


def is_english(tokens: Column, least: float = 0.05) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: t.isin(*ENGLISH))) / F.size(tokens) >= least).otherwise(F.lit(False))


def short_id(text: Column, n: int = 10) -> Column:
    return F.substring(F.sha1(text), 1, n)


def tidy_title(title: Column) -> Column:
    """A link's text as a title: size notes, file endings and doubled blanks go, underscores become blanks."""
    t = F.regexp_replace(title, r"(?i)\s*[(\[][^)\]]*\b(pdf|docx?|kb|mb)\b[^)\]]*[)\]]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\.(pdf|docx?|epub)$", ""), "_+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def title_key(title: Column) -> Column:
    """A title without size notes and, up to three times, a closing word for a language or a summary."""
    t = F.lower(tidy_title(title))
    for _ in range(3):
        t = F.regexp_replace(t, r"[\s,:(–-]+(english|german|french|spanish|en|de|fr|es|summary|version)\)?$", "")
    return t


def series_name(title: Column) -> Column:
    """A series' name: a title without its year and what hangs on it."""
    t = F.regexp_replace(tidy_title(title), r"[\s,:(–-]*(for |of )?\b(19|20)[0-9]{2}([/-][0-9]{2,4})?\)?", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def is_poor_title(title: Column) -> Column:
    """Titles that say nothing: a click word, digits, one short word."""
    t = F.lower(F.trim(title))
    return t.isin("download", "pdf", "here", "read more", "more", "link", "") | t.rlike(r"^[0-9\W]+$") | (F.length(t) < 4)


def without_site(title: Column, site: Column) -> Column:
    """A heading without the site's name at either end."""
    for sep in (" | ", " - ", " – "):
        title = F.when(F.endswith(title, F.concat(F.lit(sep), site)), F.substring(title, F.lit(1), F.length(title) - F.length(site) - len(sep))).otherwise(title)
        title = F.when(F.startswith(title, F.concat(site, F.lit(sep))), F.substring(title, F.length(site) + len(sep) + 1, F.length(title))).otherwise(title)
    return title


def other_calendar_year(text: Column) -> Column:
    """The year of an East Asian era: 令和5年, 平成元年, 昭和60年, 民國112年."""
    out = F.lit(None).cast("int")
    for era, base in (("令和", 2018), ("平成", 1988), ("昭和", 1925), ("民國", 1911)):
        n = F.regexp_extract(text, era + r"\s*([0-9]{1,3}|元)\s*年", 1)
        out = F.coalesce(out, F.when(n == "元", base + 1).when(n != "", base + n.try_cast("int")))
    return out


def covered_year(text: Column, last: int) -> Column:
    """The year that a report's heading covers: the end of a range, the commonest one, the later on ties."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?:report|review|assessment|bericht|rapport)[^0-9.\n]{0,20}((?:19|20)[0-9]{2}(?:[-/–](?:(?:19|20)?[0-9]{2}))?)(?![0-9])"), F.lit(1))

    def end(y: Column) -> Column:
        tail = F.regexp_extract(y, r"[-/–]([0-9]{2,4})$", 1)
        return F.when(tail == "", F.substring(y, 1, 4)).when(F.length(tail) == 4, tail).otherwise(F.concat(F.substring(y, 1, 2), tail)).cast("int")

    years = F.filter(F.transform(found, end), lambda y: y.between(1990, last))
    counted = F.transform(F.array_distinct(years), lambda y: F.struct(F.size(F.filter(years, lambda z: z == y)).alias("n"), y.alias("y")))
    return F.array_max(counted)["y"]


def address_year(url: Column, last: int) -> Column:
    """A year in a file name passed as a parameter, else that of a date stamp in the file's own name."""
    name = F.regexp_extract(url, r"[?&][a-z]+=(?:[^&]*/)?([^/&?]+\.(?:pdf|docx?|epub))", 1)
    stamp = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"(?<![0-9])((?:19|20)[0-9]{2})(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?![0-9])[^/]*$", 1)
    year = F.coalesce(F.nullif(F.regexp_extract(name, r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1), F.lit("")), F.nullif(stamp, F.lit(""))).cast("int")
    return F.when(year.between(1990, last), year)


def _month(name: Column) -> Column:
    return F.lpad(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3))).cast("string"), 2, "0")


def birth_date(text: Column) -> Column:
    """10 Dec 1948, December 28, 1951, 12/03/1960, 1948-12-10 or circa 1970 as YYYY-MM-DD or YYYY; empty if there is none."""
    iso = F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    mon = "((?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)"
    dmy, mdy, num = rf"\b([0-9]{{1,2}})\s+{mon}\.?\s+([0-9]{{4}})\b", rf"\b{mon}\.?\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})\b", r"\b([0-9]{2})/([0-9]{2})/([0-9]{4})\b"
    get = lambda p, i: F.regexp_extract(text, p, i)
    dash = lambda *parts: F.concat_ws("-", *parts)
    return (
        F.when(iso != "", iso).when(get(dmy, 3) != "", dash(get(dmy, 3), _month(get(dmy, 2)), F.lpad(get(dmy, 1), 2, "0")))
        .when(get(mdy, 3) != "", dash(get(mdy, 3), _month(get(mdy, 1)), F.lpad(get(mdy, 2), 2, "0"))).when(get(num, 3) != "", dash(get(num, 3), get(num, 2), get(num, 1)))
        .otherwise(F.regexp_extract(text, r"\b(1[89][0-9]{2}|20[0-9]{2})\b", 1))
    )


def register_number(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^0-9A-Z]", "")


def imo_number(text: Column) -> Column:
    return F.regexp_extract(text, "(?<![0-9])([0-9]{7})(?![0-9])", 1)


def phones(text: Column) -> Column:
    """The numbers of a field, eight to fifteen digits each."""
    digits = F.transform(F.split(text, r"[,;/]|\bor\b|\band\b"), lambda p: F.regexp_replace(p, "[^0-9]", ""))
    return F.filter(digits, lambda d: F.length(d).between(8, 15))


PLATFORMS = ["vk.com", "t.me", "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "linkedin.com", "github.com"]


def website(text: Column) -> Column:
    """A site by its host, on a platform with the account; empty if it is no address."""
    url = F.lower(F.trim(text))
    url = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))
    h, account = host(url), F.regexp_extract(url, r"^[a-z]+://[^/]+/+([^/?#]+)", 1)
    return F.when(h.isin(*PLATFORMS), F.when(account != "", F.concat(h, F.lit("/"), account)).otherwise("")).when(h.contains("."), h).otherwise("")


def email(text: Column) -> Column:
    e = F.lower(F.trim(text))
    return F.when(e.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$"), e).otherwise("")


def street(text: Column, least: int = 10) -> Column:
    """An address that is more than a city: ten letters and digits at least, one of them a digit; empty otherwise."""
    s = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when((F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]+", "")) >= least) & s.rlike("[0-9]"), s).otherwise("")


def linked_to(remarks: Column) -> Column:
    """The names that a list's remarks link an entry to."""
    return F.regexp_extract_all(remarks, F.lit(r"(?i)linked to:?\s+([^.;()]+)"), F.lit(1))


def isbn13(value: Column) -> Column:
    """An ISBN of ten digits in the form of thirteen; others unchanged."""
    s = F.upper(F.regexp_replace(value, "[^0-9Xx]", ""))
    body = F.concat(F.lit("978"), F.substring(s, 1, 9))
    total = F.aggregate(F.transform(F.split(body, ""), lambda c, i: c.cast("int") * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, b: a + b)
    return F.when(s.rlike("^[0-9]{9}[0-9X]$"), F.concat(body, ((10 - total % 10) % 10).cast("string"))).otherwise(s)


def dates_in(sentence: Column) -> Column:
    """The dates of a sentence as YYYY-MM-DD, YYYY-MM or YYYY, left to right, none within another."""
    mon = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    found = F.regexp_extract_all(sentence, F.lit(rf"\b(?:[0-9]{{1,2}} )?{mon} (?:[0-9]{{1,2}}, )?(?:19|20)[0-9]{{2}}\b|\b(?:19|20)[0-9]{{2}}\b"), F.lit(0))

    def written(d: Column) -> Column:
        year = F.regexp_extract(d, r"((?:19|20)[0-9]{2})$", 1)
        day = F.coalesce(F.nullif(F.regexp_extract(d, r"^([0-9]{1,2}) ", 1), F.lit("")), F.nullif(F.regexp_extract(d, r" ([0-9]{1,2}), ", 1), F.lit("")))
        name = F.regexp_extract(d, "([A-Z][a-z]+)", 1)
        return F.when(name == "", year).when(day.isNull(), F.concat_ws("-", year, _month(name))).otherwise(F.concat_ws("-", year, _month(name), F.lpad(day, 2, "0")))

    return F.transform(found, written)


def one_edit(a: Column, b: Column) -> Column:
    """Whether one letter is added, dropped, changed, or swapped with the next one."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    i, j = F.get(places, F.lit(0)), F.get(places, F.lit(1))
    one = F.lit(1)
    swapped = (F.length(a) == F.length(b)) & (F.size(places) == 2) & (j == i + 1) & (F.substring(a, i, one) == F.substring(b, j, one)) & (F.substring(a, j, one) == F.substring(b, i, one))
    return (F.levenshtein(a, b) <= 1) | F.coalesce(swapped, F.lit(False))


def latin(text: Column) -> Column:
    """Cyrillic letters in Latin ones."""
    t = F.lower(text)
    for pair in ("ж:zh", "ч:ch", "ш:sh", "щ:shch", "ю:yu", "я:ya", "х:kh", "ц:ts", "ъ:", "ь:"):
        a, _, b = pair.partition(":")
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.translate(t, "абвгдеёзийклмнопрстуфыэ", "abvgdeeziiklmnoprstufye")


# Words for legal forms.
LEGAL_FORMS = ["ooo", "oao", "ltd", "llc", "inc", "gmbh", "ag", "sa", "co", "company", "limited", "jsc", "group"]


def distinctive(name: Column) -> Column:
    """The words of a company's name that aren't legal forms, three letters or more."""
    return F.filter(F.split(F.regexp_replace(latin(name), r"[^\p{L}\p{N}]+", " "), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*LEGAL_FORMS))


def aliases(written: Column) -> Column:
    """The names in `A/B fka C (sponsor)` or `A < umbrella`, brackets and what they belong to left out."""
    plain = F.regexp_replace(F.regexp_replace(written, r"\([^)]*\)", " "), "<.*$", "")
    return F.filter(F.transform(F.split(plain, r"/|,|;|\b(?:fka|aka|a\.k\.a\.|formerly)\b"), lambda x: F.trim(x)), lambda x: F.length(x) > 1)


def without_templates(wikitext: Column, depth: int = 3) -> Column:
    for _ in range(depth):
        wikitext = F.regexp_replace(wikitext, r"\{\{[^{}]*\}\}", "")
    return wikitext


def infobox(wikitext: Column) -> Column:
    """Fields of an infobox as a map; of a name that is repeated the last value stays."""
    lines = F.regexp_extract_all(wikitext, F.lit(r"(?m)^\|\s*(\w+\s*=[^\n]*)$"), F.lit(1))
    pairs = F.transform(lines, lambda l: F.struct(F.trim(F.regexp_extract(l, r"^(\w+)", 1)).alias("key"), F.trim(F.regexp_replace(l, r"^\w+\s*=", "")).alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(pairs, lambda p: p["key"] == n), -1)["value"])))


def wiki_links(wikitext: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(wikitext, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), lambda x: F.trim(x)))


#: Families of relation words, the first that stands near a name.
RELATIONS = [("parent", r"parent|owned by|subsidiary"), ("ally", r"alli(ed|ance)|ally|support"), ("rival", r"rival|oppos|against"), ("leader", r"led by|leader|command")]


def relation_near(text: Column, name: Column, around: int = 60) -> Column:
    """The relation whose words stand within `around` characters of a name's first use."""
    at = F.position(name, text)
    near = F.lower(F.substring(text, F.greatest(at - around, F.lit(1)), F.length(name) + F.least(F.lit(around), at - 1) + around))
    out = F.lit(None).cast("string")
    for family, words in reversed(RELATIONS):
        out = F.when(near.rlike(words), family).otherwise(out)
    return F.when(at > 0, out)


def narrative_sentences(text: Column) -> Column:
    """Sentences; a full stop behind a title, an initial or a number doesn't end one."""
    held = F.regexp_replace(text, r"\b(Mr|Mrs|Dr|St|No|Gen|Lt|[A-Z])\.\s", "$1\u0001 ")
    return F.filter(F.transform(F.split(held, r"(?<=[.!?])\s+(?=\p{Lu})"), lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: F.length(s) > 0)


def passage_place(text: Column, words: list[str]) -> Column:
    """Where a passage begins whose words follow each other with anything but letters between, from 1; 0 if nowhere."""
    return F.regexp_instr(F.lower(text), F.lit(r"[^\p{L}\p{N}]+".join(re.escape(w.lower()) for w in words)))


def widened(text: Column, at: Column) -> Column:
    """The sentence around a place (from 1)."""
    before = F.regexp_extract(F.substring(text, F.lit(1), at - 1), r"([^.!?]*)$", 1)
    after = F.regexp_extract(F.substring(text, at, F.length(text)), r"^([^.!?]*[.!?]?)", 1)
    return F.when(at > 0, F.trim(F.concat(before, after)))


def slug(text: Column, n: int = 60) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(s, 1, n), "-+$", "")


def is_safe_target(path: Column) -> Column:
    """Whether a relative path stays below its folder."""
    return ~path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|\x00")


# First bytes of file kinds, in hexadecimal.
MAGIC = [("pdf", "25504446"), ("zip", "504B0304"), ("png", "89504E47"), ("gif", "47494638"), ("html", "3C")]


def sniffed(content: Column) -> Column:
    """The kind of a file by its first bytes, "unknown" for others."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit("unknown")
    for kind, first in reversed(MAGIC):
        out = F.when(head.startswith(first), kind).otherwise(out)
    return out


def needs_ocr(chars: Column, pages: Column, least: int = 100) -> Column:
    """Whether a file is a scan: too few characters a page."""
    return (pages > 0) & (chars < least * pages)


def cleaned_page(text: Column) -> Column:
    """A page's text: words broken at line ends joined, control characters and doubled blanks gone, at most one empty line."""
    t = F.regexp_replace(text, r"(\p{Ll})-\n(\p{Ll})", "$1$2")
    t = F.regexp_replace(F.regexp_replace(t, r"[\x00-\x08\x0B-\x1F]", ""), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def looks_like_references(text: Column) -> Column:
    """Whether a sentence is from a list of references: several years in brackets, addresses or page marks."""
    marks = F.size(F.regexp_extract_all(text, F.lit(r"(?i)https?://|\bpp?\. ?[0-9]|\b(?:ibid|et al|vol)\b|\((?:19|20)[0-9]{2}[a-z]?\)"), F.lit(0)))
    return marks >= 2


def looks_like_table(text: Column) -> Column:
    """Whether a sentence is a table, a caption or a line of contents: leaders of dots, a caption's head, or more than 15 % digits."""
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return text.contains(".....") | text.contains("…………") | text.rlike(r"\b(Figure|Table|Chart|Map)\s+[0-9]+[.:]|^Source:") | (digits > 0.15 * F.length(text))
