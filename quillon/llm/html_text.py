"""Main text of web pages by consensus paths: pages of a host vote on the container that holds the article."""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.storage import materialize, table

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>",
    re.S,
)
#: What any of them begins with. An opening without an end leaves no tags after it, so the rest is text.
_START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "noembed", "noframes", "xmp", "template", "svg", "math", "object", "canvas", "audio", "video"}
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr",
}
_JUNK_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "head"}
_JUNK_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form", "note"}
_JUNK_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation",
    "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert",
    "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations",
    "comment", "comments", "commentlist", "disqus", "replies", "respond", "discussion", "pagination", "pager", "widget", "toolbar", "search", "copyright", "skip", "disclaimer",
}
_KEPT_TAGS = {"html", "body", "main"}
#: A block that starts ends an open paragraph; these end an open element of the same group.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_BARRIER = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
#: The deepest container with this share of a page's plain text is taken for the article's.
SHARE = 0.8
#: Around the container, text of these stays, and of others that hold one of them.
_PROSE = {"p", "span", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "header", "blockquote", "pre", "address", "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "figure", "figcaption", "details", "summary"}
#: Up to so many bytes, measured, the hosts' paths are sent to every task and the pages stay where they are.
SENT = 32 << 20
#: Beyond that, places that each host's pages are dealt to when they meet the host's path.
SALTS = 64


def _words(value: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())


class Page:
    """Elements and text runs of a page. Elements: parent, generalised step of the path, junk, within an article or main
    element; runs: element, break before, text, in a link.

    Each character is read a fixed number of times and open elements are counted by tag, so the time grows with the
    length of the page, however deep or broken its markup is.
    """

    def __init__(self, html: str):
        self.parent, self.step, self.tag, self.junk, self.own = [-1], [""], [""], [False], [False]
        self.runs: list[tuple[int, bool, str, bool]] = []
        stack, at, fresh, link, open_ = [0], 0, True, False, Counter()

        def close_from(i: int) -> None:
            open_.subtract(self.tag[e] for e in stack[i:])
            del stack[i:]

        while True:
            start = _START.search(html, at)
            m = start and _TOKEN.match(html, start.start())
            end = m.start() if m else len(html)
            if end > at:
                self.runs.append((stack[-1], fresh, html_lib.unescape(html[at:end]), link))
                fresh = False
            if not m:
                break
            at = m.end()
            name = m[2] and m[2].lower()
            if not name:
                continue
            if m[1]:
                if name == "a":
                    link = False
                if name in _INLINE and name != "span":
                    continue
                if name != "span":
                    fresh = True
                if name == "span":
                    if self.tag[stack[-1]] == name:
                        close_from(len(stack) - 1)
                elif open_[name]:
                    i = len(stack) - 1
                    while self.tag[stack[i]] != name:
                        i -= 1
                    close_from(i)
                continue
            if name in _RAW:
                if not m[3].endswith("/"):
                    close = _RAW_END[name].search(html, at)
                    at = close.start() if close else len(html)
                fresh = True
                continue
            if name == "a":
                link = True
                continue
            if name in _INLINE and name != "span":
                continue
            if name != "span":
                fresh = True
                link = False
                while self.tag[stack[-1]] == "span" or (self.tag[stack[-1]] == "p" and name not in _VOID):
                    close_from(len(stack) - 1)
            if name in _VOID:
                continue
            if any(open_[t] for t in _ENDS.get(name, ())):
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] in _BARRIER.get(name, ()):
                        break
                    if self.tag[stack[i]] in _ENDS[name]:
                        close_from(i)
                        break
            stack.append(self._element(stack[-1], name, m[3]))
            open_[name] += 1

    def _element(self, parent: int, name: str, written: str) -> int:
        attributes = {a.lower(): html_lib.unescape(b or c or d) for a, b, c, d in _ATTRIBUTE.findall(written)} if written.strip() else {}
        classes = sorted({re.sub(r"[\d>]+", "#", c.lower()) for c in attributes.get("class", "").split()})
        junk = self.junk[parent]
        if not junk and name not in _KEPT_TAGS:
            own_header = name == "header" and self.own[parent]
            words = {*_words(attributes.get("class", "")), *_words(attributes.get("id", ""))}
            junk = (name in _JUNK_TAGS and not own_header) or attributes.get("role", "").lower() in _JUNK_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
            junk = junk or bool(words & (_JUNK_WORDS - {"header"} if own_header or name == "article" else _JUNK_WORDS)) or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))
        self.parent.append(parent)
        self.tag.append(name)
        self.step.append(".".join([name, *classes]))
        self.own.append(self.own[parent] or name in ("article", "main"))
        self.junk.append(junk)
        return len(self.parent) - 1

    def path(self, e: int) -> str:
        """The steps from the page down to e."""
        steps = []
        while e > 0:
            steps.append(self.step[e])
            e = self.parent[e]
        return "".join(f">{x}" for x in reversed(steps))

    def at(self, path: str) -> set[int]:
        """The elements with that path that aren't junk."""
        steps = path.split(">")[1:]
        depth = [0] + [-1] * (len(self.parent) - 1)  # steps agreed so far, -1 off the path
        for e in range(1, len(depth)):
            d = depth[self.parent[e]]
            if 0 <= d < len(steps) and steps[d] == self.step[e]:
                depth[e] = d + 1
        return {e for e, d in enumerate(depth) if d == len(steps) and not self.junk[e]}

    def best(self) -> tuple[int, int]:
        """The element to vote for and the plain text (characters outside links and junk) that it holds."""
        mass = [0] * len(self.parent)
        for e, _, text, link in self.runs:
            if not self.junk[e] and not link:
                mass[e] += len(text.strip())
        for e in range(len(mass) - 1, 0, -1):
            mass[self.parent[e]] += mass[e]
        self.mass = mass
        if not mass[0]:
            return 0, 0
        found = 0
        for e in range(1, len(mass)):
            if self.parent[e] == found and mass[e] >= SHARE * mass[0] and self.tag[e] not in ("p", "span"):
                found = e
        outer = found
        while outer > 0:
            if self.tag[outer] in ("article", "main"):
                return outer, mass[outer]
            outer = self.parent[outer]
        return found, mass[found]

    def text(self, inside: list[bool]) -> str:
        parts = []
        for e, fresh, text, _ in self.runs:
            if inside[e] and not self.junk[e]:
                parts.append(f" {text}" if fresh else text)
            else:
                parts.append(" ")
        return " ".join("".join(parts).split())

    def within(self, roots: set[int]) -> list[bool]:
        inside = [False] * len(self.parent)
        for e, p in enumerate(self.parent):
            inside[e] = e in roots or (p >= 0 and inside[p])
        return inside

    def around(self, e: int) -> tuple[set[int], set[int]]:
        """The elements that hold e, for text of their own, and the blocks beside e and beside those; none where e is an
        article or main element."""
        if e == 0 or self.tag[e] in ("article", "main"):
            return set(), set()
        holders, at = set(), e
        while at > 0:
            at = self.parent[at]
            holders.add(at)
        prose = [t in _PROSE and m > 0 and not j for t, m, j in zip(self.tag, self.mass, self.junk, strict=True)]
        for i in range(len(prose) - 1, 0, -1):
            prose[self.parent[i]] |= prose[i]
        return holders, {i for i in range(1, len(prose)) if prose[i] and not self.junk[i] and self.parent[i] in holders and i not in holders and i != e}

    def extract(self, path: str | None) -> str:
        own, _ = self.best()
        holders, blocks = self.around(own)
        chosen = self.path(own)
        mine = self.within(self.at(chosen) | {own} | blocks)
        for e in holders:
            mine[e] = True
        if path is None or path == chosen:
            return self.text(mine)
        agreed = self.within(self.at(path))
        lost = any(mine[e] and not agreed[e] and not self.junk[e] and text.strip() for e, _, text, _ in self.runs)
        return self.text(mine if lost else agreed)


def host(url):
    """The host of an address, lower case, without www.; empty if there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))), r"^www\.", "")


def container_votes(pages: DataFrame) -> DataFrame:
    """Votes host, path, weight: one line per task and pair, summed before any shuffle. A page weighs the square root of its text."""

    def run(batches):
        import pyarrow as pa

        votes: dict[tuple[str, str], float] = {}

        def out():
            rows = list(votes.items())
            votes.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.float64())], names=["host", "path", "weight"])

        for batch in batches:
            for h, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html or "")
                e, mass = page.best()
                if e:
                    path = page.path(e)
                    votes[h, path] = votes.get((h, path), 0.0) + mass**0.5
            if len(votes) > 10_000:
                yield out()
        yield out()

    return pages.select(F.coalesce(host(F.col("url")), F.lit("")).alias("host"), "html").mapInArrow(run, "host string, path string, weight double")


def extract(pages: DataFrame) -> DataFrame:
    """A row for each page: page_id, url, text, n_chars.

    pages needs page_id, url and html; a null html is empty, a null url has the host ''. Each page proposes the deepest
    container that holds most of its plain text, or the article or main element around it; a host's path is the one
    with the greatest weight of votes (ties: the first by code point). Paths are tags with their classes, digits
    generalised. A page's own text is its container's and, where that is no article or main element, that of the blocks
    beside it and around it that aren't junk (_PROSE). A page is read again by its host's path; where that isn't found,
    or lacks any of the page's own text, it keeps its own. Pages without any markup are text as they are. Repeated rows are read each.
    """
    votes = container_votes(pages).groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    won = votes.groupBy("host").agg(F.min_by("path", F.struct(-F.round("weight", 3), F.col("path"))).alias("__path")).withColumnRenamed("host", "__host")
    won = materialize(won, "host-paths")
    size = won.agg(F.sum(F.octet_length("__host") + F.octet_length("__path") + 32)).collect()[0][0] or 0
    placed = pages.select("page_id", "url", "html", F.coalesce(host(F.col("url")), F.lit("")).alias("__h"))
    if size <= SENT:
        joined = placed.join(F.broadcast(won), F.col("__h") == F.col("__host"), "left")
    else:
        # a host may hold a third of all pages: its path is dealt to SALTS places, and its pages among them
        won = won.withColumn("__to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = placed.withColumn("__salt", salt).join(won, (F.col("__h") == F.col("__host")) & (F.col("__salt") == F.col("__to")), "left")
    with_path = joined.select("page_id", "url", "html", "__path")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [Page(html or "").extract(path) for html, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return with_path.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
