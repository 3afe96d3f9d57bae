"""File readers and writers beyond Spark's own: links of web pages, list XML, zipped CSV, books, export with manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINK_SCHEMA = "array<struct<url:string,title:string>>"


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, url, title of each link of a page, absolute, in order; anchors and scripts aside."""

    def run(batches):
        from html.parser import HTMLParser
        from urllib.parse import urljoin

        import pandas as pd

        class Links(HTMLParser):
            def __init__(self, base):
                super().__init__(convert_charrefs=True)
                self.base, self.found, self.open = base, [], None

            def handle_starttag(self, tag, attrs):
                given = dict(attrs)
                if tag == "base" and given.get("href"):
                    self.base = urljoin(self.base, given["href"])
                if tag == "a":
                    self.handle_endtag("a")
                    if given.get("href") and not given["href"].lower().startswith(("#", "javascript:", "mailto:")):
                        self.open = [urljoin(self.base, given["href"].strip()).split("#")[0], given.get("title") or ""]

            def handle_data(self, data):
                if self.open:
                    self.open[1] += data

            def handle_endtag(self, tag):
                if tag == "a" and self.open:
                    self.found.append((self.open[0], " ".join(self.open[1].split())))
                    self.open = None

        for pdf in batches:
            rows = []
            for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                parser = Links(url or "")
                parser.feed(html or "")
                rows += [(page_id, i, u, t) for i, (u, t) in enumerate(parser.found)]
            yield pd.DataFrame(rows, columns=["page_id", "place", "url", "title"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, place int, url string, title string")


def heading(html: Column) -> Column:
    """og:title, else the first h1, without markup."""
    og = F.regexp_extract(html, r'(?is)<meta[^>]+property="og:title"[^>]+content="([^"]*)"', 1)
    h1 = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(F.when(og != "", og).otherwise(h1), "<[^>]*>", " "), r"\s+", " "))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and tags, spaces tidied: JVM-side throughout."""
    no_code = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_code, "(?s)<!--.*?-->|<[^>]*>", " "), r"\s+", " "))


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", separator).option("mode", "PERMISSIVE").csv(path)


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The rows of the CSV files within zip archives: one archive is one task, read as a stream."""
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches):
        import csv
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(".csv")):
                        with z.open(name) as f:
                            rows = []
                            for row in csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline="")):
                                rows.append([row.get(c) for c in columns])
                                if len(rows) == 5_000:
                                    yield pd.DataFrame(rows, columns=columns)
                                    rows = []
                            if rows:
                                yield pd.DataFrame(rows, columns=columns)

    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """path, title, place, section text of EPUB books in reading order."""

    def run(batches):
        import io
        import posixpath
        import re
        import zipfile
        from html import unescape
        from xml.etree import ElementTree

        import pandas as pd

        tag = lambda e: e.tag.rsplit("}", 1)[-1]
        for pdf in batches:
            rows = []
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                z = zipfile.ZipFile(io.BytesIO(content))
                root = next(e.attrib["full-path"] for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if tag(e) == "rootfile")
                package = ElementTree.fromstring(z.read(root))
                title = next((e.text for e in package.iter() if tag(e) == "title"), None)
                items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if tag(e) == "item"}
                for i, ref in enumerate(e.attrib["idref"] for e in package.iter() if tag(e) == "itemref"):
                    page = z.read(posixpath.join(posixpath.dirname(root), items[ref])).decode("utf-8", "replace")
                    text = " ".join(unescape(re.sub(r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ", page)).split())
                    rows.append((where, title, i, text))
            yield pd.DataFrame(rows, columns=["path", "title", "place", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, title string, place int, text string")


def exact_duplicates(files: DataFrame) -> DataFrame:
    """files(id, content) with sha256 and status: of equal contents the smallest id is stored, the others are duplicates."""
    digest = files.select("id", F.sha2("content", 256).alias("sha256"))
    first = digest.groupBy("sha256").agg(F.min("id").alias("first"))
    return digest.join(first, "sha256").select("id", "sha256", F.when(F.col("id") == F.col("first"), "stored").otherwise("duplicate").alias("status"))


def fingerprint(df: DataFrame) -> DataFrame:
    """rows and an order-free checksum of a table."""
    each = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(each.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))


def export(tables: dict[str, DataFrame], folder: str, private: dict[str, Column] | None = None) -> dict:
    """Writes each table as Parquet without its private rows; returns the manifest, which is also written as JSON."""
    manifest = {}
    for name, df in tables.items():
        kept = df.filter(~F.coalesce((private or {})[name], F.lit(False))) if name in (private or {}) else df
        kept.write.mode("overwrite").parquet(f"{folder}/{name}")
        manifest[name] = fingerprint(df.sparkSession.read.parquet(f"{folder}/{name}")).collect()[0].asDict()
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest


def verify(spark: SparkSession, folder: str) -> dict[str, bool]:
    """Whether each table of an export is as its manifest says."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").collect()[0][0])
    return {name: fingerprint(spark.read.parquet(f"{folder}/{name}")).collect()[0].asDict() == said for name, said in manifest.items()}


def atom(entries: DataFrame, title: str) -> DataFrame:
    """Lines of an Atom feed of entries(id, title, updated), newest first."""
    def safe(c: str) -> Column:
        return F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    entry = F.concat(F.lit("<entry><id>"), safe("id"), F.lit("</id><title>"), safe("title"), F.lit("</title><updated>"), safe("updated"), F.lit("</updated></entry>"))
    lines = entries.orderBy(F.desc("updated"), "id").select(entry.alias("value"))
    head = entries.sparkSession.createDataFrame([(f'<feed xmlns="http://www.w3.org/2005/Atom"><title>{title}</title>',)], "value string")
    return head.unionByName(lines).unionByName(entries.sparkSession.createDataFrame([("</feed>",)], "value string"))
