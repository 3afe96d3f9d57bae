"""Operators on literal fixtures: small libraries whose results are known."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.functions import scalar
from quillon.operators import facets, graph, names, relational, text, works
from quillon.sources import files
from quillon.streaming import updates


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def column(spark, expression, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression.alias("x")).first()[0]


def test_fold(spark):
    assert scalar.fold_text("Rechtsextremismus Ärger Øst Straße łódź Đ") == "rechtsextremismus arger ost strasse lodz d"
    got = spark.createDataFrame([("Ärger",), (None,)], "s string").select(scalar.fold("s").alias("f")).collect()
    assert [r["f"] for r in got] == ["arger", None]


def test_addresses(spark):
    url = F.col("u")
    assert column(spark, scalar.address_norm(url), u="https://WWW.Example.org/A/b/?q=1#x") == "example.org/a/b"
    assert column(spark, scalar.domain_family(url), u="https://docs.example.org/x") == "example.org"
    assert column(spark, scalar.address_key(url), u="https://example.org/en/report_en.pdf") == column(spark, scalar.address_key(url), u="https://example.org/de/report_de.pdf")


@pytest.mark.parametrize(("value", "right"), [("978-0-306-40615-7", True), ("0-306-40615-2", True), ("0-306-40615-3", False), ("0-8044-2957-X", True), ("12", False)])
def test_isbn(spark, value, right):
    assert column(spark, scalar.isbn_ok(F.col("v")), v=value) is right


def test_years_and_codes(spark):
    assert column(spark, scalar.guess_year(F.col("t"), F.col("u"), 2025), t="Report 2019 and 2021", u="") == 2021
    assert column(spark, scalar.guess_year(F.col("t"), F.col("u"), 2025), t="Report 20215", u="http://x/2020/a") == 2020
    assert column(spark, scalar.era_year(F.col("t")), t="Reiwa 3 report") == 2021
    assert column(spark, scalar.cves(F.col("t"), 2025), t="cve-2021-44228, CVE‑2019‑0708, CVE-1990-1234") == ["CVE-2021-44228", "CVE-2019-0708"]
    assert column(spark, scalar.techniques(F.col("t")), t="T1059.001 T1566 XT1234") == ["T1059.001", "T1566"]
    assert column(spark, scalar.page_of(F.col("o"), F.lit(12)), o=[0, 10, 20]) == 2
    assert [scalar.roman(x) for x in ("XIV", "mcmxc", "IIX")] == [14, 1990, None]


def test_facets_and_console(spark):
    docs = spark.createDataFrame([(1, "en", 2020), (2, "en", 2022), (3, "de", None)], "doc_id long, lang string, year int")
    assert rows(facets.apply(docs, facets.parse_console("lang:en year:2021..")[0]).select("doc_id")) == [(2,)]
    assert rows(facets.apply(docs, facets.Filters(undated=True)).select("doc_id")) == [(3,)]
    f, problems = facets.parse_console('lang:en "two words" color:red')
    assert f.words == ("two words",) and problems == ["color:red"]
    for line in ("lang:en year:2020..2022 drone", "year:none", 'topic:"a b"'):
        assert facets.parse_console(facets.to_console(facets.parse_console(line)[0])) == facets.parse_console(line)


def test_counts_equal_their_lists(spark):
    docs = spark.createDataFrame([(i, "en" if i % 3 else "de", 2000 + i % 4) for i in range(40)], "doc_id long, lang string, year int")
    for r in docs.groupBy("lang", "year").count().collect():
        assert facets.apply(docs, facets.Filters(lang=r["lang"], year=r["year"])).count() == r["count"]


LIBRARY = [(1, "The drone attack. Drone swarm and the drone."), (2, "Drohne und Angriff"), (3, "of the sea, out of the blue"), (4, "")]


def test_search_and_topics(spark):
    docs = spark.createDataFrame(LIBRARY, "doc_id long, text string")
    counts = text.token_counts(docs)
    assert rows(text.search(counts, ["dro*"])) == [(1,), (2,)]
    assert rows(text.phrase(docs, ["of", "the"])) == [(3, 2)]
    scores = dict(rows(text.bm25(docs, ["drone", "the"])))
    assert set(scores) == {1, 3} and scores[1] > scores[3]
    terms = spark.createDataFrame([("air", "drone"), ("air", "dro*"), ("air", "swa*"), ("sea", "of the")], "topic string, term string")
    assert rows(text.topic_hits(docs, terms)) == [(1, "air", "drone", 3), (1, "air", "swa*", 1), (2, "air", "dro*", 1), (3, "sea", "of the", 2)]
    assert [r["topic"] for r in text.classify(docs, terms).collect()] == ["air"]


def test_pairs_within_a_window(spark):
    marks = spark.createDataFrame([(1, 0, "A"), (1, 5000, "A"), (1, 100, "B"), (1, 900, "C")], "doc_id long, start long, actor string")
    assert rows(names.pairs(marks)) == [(1, "A", "B", 1)]


def test_as_of_and_median(spark):
    known = spark.createDataFrame([("x", 2000, 1.0), ("x", 2005, 2.0), ("y", 2010, 3.0)], "k string, year int, value double")
    asked = spark.createDataFrame([("x", 1999), ("x", 2004), ("x", 2005), ("y", 2020)], "k string, year int")
    assert sorted(tuple(r) for r in relational.as_of(asked, known, "k", "year", "value").select("k", "year", "value").na.fill(-1.0).collect()) == [("x", 1999, -1.0), ("x", 2004, 1.0), ("x", 2005, 2.0), ("y", 2020, 3.0)]
    assert spark.createDataFrame([(i,) for i in (4, 1, 3, 2)], "v int").agg(relational.upper_median("v")).first()[0] == 3


def test_npmi_literals(spark):
    values = [(10.0, 10, 10, 100), (1.0, 10, 10, 100), (0.0, 10, 10, 100)]
    got = spark.createDataFrame(values, "ab double, a int, b int, n int").select(graph.npmi(F.col("ab"), F.col("a"), F.col("b"), F.col("n")).alias("x")).collect()
    assert [r["x"] for r in got] == [1.0, 0.0, 0.0]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (10, 11), (11, 12), (12, 10)], "a long, b long")
    found = graph.components(edges, checkpoint=lambda df: df.sparkSession.createDataFrame(df.collect(), df.schema))
    assert rows(found) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (10, 10, 3), (11, 10, 3), (12, 10, 3)]
    square = spark.createDataFrame([(1, 2), (1, 3), (4, 2), (4, 3)], "a long, b long")
    assert [(r["a"], r["b"], r["shared"]) for r in graph.leads(square).orderBy("a").collect()] == [(1, 4, 2), (2, 3, 2)]
    groups = graph.louvain([1, 2, 3, 4, 5, 6], {(1, 2): 1.0, (2, 3): 1.0, (1, 3): 1.0, (4, 5): 1.0, (5, 6): 1.0, (4, 6): 1.0, (3, 4): 0.1})
    assert len({groups[i] for i in (1, 2, 3)}) == 1 and len(set(groups.values())) == 2
    assert graph.cluster(["a", "b", "c"], {("a", "b"): 0.9, ("b", "c"): 0.1}, 0.25) == [["a", "b"], ["c"]]


def test_a_longer_cheaper_way_does_not_hide_a_shorter_one(spark):
    edges = [("s", "x", 1.0), ("x", "y", 1.0), ("y", "m", 1.0), ("s", "p", 0.1), ("p", "q", 0.1), ("q", "r", 0.1), ("r", "u", 0.1), ("u", "m", 0.1), ("m", "d", 1.0), ("d", "e", 1.0), ("e", "t", 1.0)]
    found = graph.paths(spark.createDataFrame(edges, "a string, b string, cost double"), "s", "t", hub_cost=0.0).first()
    assert found["path"] == ["s", "x", "y", "m", "d", "e", "t"]


def test_names(spark):
    gazetteer = spark.createDataFrame([("a", "Grey Wolf"), ("b", "Grey"), ("b", "GW"), ("c", "Bear"), ("d", "bear")], "actor string, name string")
    prepared = {(r["actor"], r["name"]): r["reason"] for r in names.prepare(gazetteer, ["grey"]).collect()}
    assert prepared == {("a", "Grey Wolf"): "", ("b", "Grey"): "generic", ("b", "GW"): "too short", ("c", "Bear"): "shared", ("d", "bear"): "shared"}
    docs = spark.createDataFrame([(1, "A Grey Wolf met Grey. grey wolf"), (2, None)], "doc_id long, text string")
    assert rows(names.match(docs, gazetteer)) == [(1, "a", "Grey Wolf", 2, 11), (1, "b", "Grey", 16, 20)]
    known = spark.createDataFrame([("Grey Wolf", 9), ("Wolf Pack", 0), ("Bear", 3)], "name string, docs int")
    assert [r["name"] for r in names.suggest(known, "wolf").collect()] == ["Wolf Pack", "Grey Wolf"]


def test_works_and_series(spark):
    held = spark.createDataFrame([(1, "k", "en", 100), (2, "k", "de", 120), (3, None, "de", 5), (4, None, "de", 5)], "id long, key string, lang string, chars int")
    found = works.group_works(held, [["key"]], checkpoint=lambda df: df.sparkSession.createDataFrame(df.collect(), df.schema))
    assert rows(found) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    titles = [("s", lang, f"Annual Report {y}", y) for lang, years in (("cs", range(2018, 2025)), ("en", (2018, 2019, 2020, 2022, 2023))) for y in years]
    proposed = works.propose_series(spark.createDataFrame(titles, "source string, lang string, title string, year int").withColumn("title", F.concat("title", F.lit(" threats")))).collect()
    assert [(r["langs"], r["since"]) for r in proposed] == [("cs,en", 2018)]


def test_export_and_verify(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    files.export({"t": t}, str(tmp_path), {"t": F.col("id") == 2})
    assert files.verify(spark, str(tmp_path)) == {"t": True}
    t.write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert files.verify(spark, str(tmp_path)) == {"t": False}


def test_pages(spark):
    html = '<base href="http://x.org/d/"><h1>A <b>B</b></h1><a href="r.pdf">Read  it</a><a href="#t">no</a><script>var a="<p>";</script>'
    pages = spark.createDataFrame([(1, "http://x.org/", html), (2, None, None)], "page_id long, url string, html string")
    assert rows(files.page_links(pages)) == [(1, 0, "http://x.org/d/r.pdf", "Read it")]
    assert column(spark, files.heading(F.col("h")), h=html) == "A B"
    assert "var" not in column(spark, files.visible_text(F.col("h")), h=html)


def test_zipped_csv_and_xml(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "id,name\n1,Ä\n2,b\n")
    assert rows(files.read_zipped_csv(spark, f"{tmp_path}/a.zip", ["id", "name"])) == [("1", "Ä"), ("2", "b")]
    (tmp_path / "l.xml").write_text("<list><e><n>x</n></e><e><n>y</n></e></list>")
    assert rows(files.read_xml(spark, f"{tmp_path}/l.xml", "e").select("n")) == [("x",), ("y",)]


def test_streaming_takes_up_new_files_only(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    row = lambda i: (i, dt.datetime(2024, 1, 1 + i % 3), i, "view", 1.0)
    spark.createDataFrame([row(i) for i in range(4)], schema).write.parquet(f"{tmp_path}/in")
    put = lambda: updates.append_new(updates.stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), f"{tmp_path}/out", f"{tmp_path}/state", "event_id")
    put()
    spark.createDataFrame([row(9)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    put()
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3, 9]
    spark.createDataFrame([row(3), row(9), row(11), row(11)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    put()
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3, 9, 11]
    daily = updates.daily(updates.stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema))
    updates.run_once(daily, "daily", "complete", f"{tmp_path}/daily")
    assert sum(r["n"] for r in spark.table("daily").collect()) == 9


def test_stale_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    index = docs.filter("doc_id = 1").withColumn("h", F.sha2(F.concat_ws("|", F.lit("r1"), "text"), 256))
    assert [r["doc_id"] for r in updates.stale(docs, index, "r1").collect()] == [2]
    assert updates.stale(docs, index, "r2").count() == 2
