"""Registered queries against their SQL on small tables with odd rows."""

import datetime as dt
import itertools
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillon.operators import graph, matching
from quillon.plans import ORACLE_SQL, QUERIES
from quillon.sources.shared import keep


def both(spark, folder, query, name, table):
    """The query's rows and its SQL's, over one table written to folder."""
    pq.write_table(table, f"{folder}/{name}.parquet")
    df = QUERIES[query](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    columns = ", ".join(f'"{c}"' for c in df.columns)
    told = con.execute(f"SELECT {columns} FROM ({ORACLE_SQL[query]})").fetchall()
    return sorted((tuple(r) for r in df.collect()), key=repr), sorted(told, key=repr)


def events(rows):
    """event_id, seconds (null: no time), user_id, event_type."""
    start = dt.datetime(2024, 1, 1)
    ids, at, users, kinds = zip(*rows, strict=True)
    times = [None if s is None else start + dt.timedelta(microseconds=round(s * 1e6)) for s in at]
    return pa.table({"event_id": pa.array(ids, pa.int64()), "ts": pa.array(times, pa.timestamp("us")), "user_id": pa.array(users, pa.int64()), "event_type": pa.array(kinds, pa.string())})


def test_join_band_rounds_seconds(spark, tmp_path):
    ends = [(1, 0.4, 1, "a"), (2, 3600.6, 1, "b"), (3, 0.6, 2, "a"), (4, 3601.4, 2, "b"), (5, 0.5, 3, "a"), (6, 3601.5, 3, "b"), (7, 1.5, 4, "a"), (8, 3601.5, 4, "b"), (9, 9.4, 5, "b"), (10, 9.6, 5, "a"), (11, None, 5, "c"), (12, 0.0, 6, "a"), (12, 1.0, 6, "a"), (13, 5.0, 6, "b")]
    mine, told = both(spark, tmp_path, "join_band", "events", events(ends))
    assert told == [(u, "a", "b", 1) for u in (2, 4, 5, 6)]  # 1 and 3 are a second too far apart
    assert mine == told


def test_window_densest_rounds_seconds(spark, tmp_path):
    ends = [(1, 0.4, 1, "a"), (2, 86400.6, 1, "a"), (3, 0.6, 2, "a"), (4, 86401.4, 2, "a"), (5, 0.5, 3, "a"), (6, 86401.5, 3, "a"), (7, None, 4, "a"), (8, None, 4, "a"), (9, 3.0, 4, "a")]
    mine, told = both(spark, tmp_path, "window_densest", "events", events(ends))
    assert told == [(1, 1), (2, 2), (3, 1), (4, 2)]
    assert mine == told


def test_passages_cut_at_white_space(spark, tmp_path):
    long = "word " * 80
    texts = [
        long + "nation " + "x" * 200 + " " + "y" * 54 + " last\n" + long,  # the cut ends with a line feed
        long + "nation " + "x" * 253 + " last\r\n" + long, "nation a\n", long + "nation\n", "nation a\x0bb \x0b", long + "nation " + "x" * 200 + "\x0b" + "y" * 400,
        "İİ NATİON b", "ẞ𝄞 é NATION b", "z" * 300 + "\x0b" + "z" * 100 + "tion a\u2028b\u0085", None, "",
    ]
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    mine, told = both(spark, tmp_path, "passages", "documents", table)
    assert len(told) == 8
    assert mine == told


def test_names_meet_tokens_where_the_document_is(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The North Front and NORTH FRONT met Ertiona"), (1, "Ertio in North"), (2, None), (3, ""), (4, "Front " * 50 + "North Front")], "doc_id long, text string")
    rows = [("A", "North Front", ["North", "Front"], False, False), ("B", "Ertio", ["Ertio"], True, False), ("C", "Front", ["Front"], False, True)]
    names = spark.createDataFrame(rows, "actor string, name string, tokens array<string>, manual boolean, person boolean")
    told = {}
    for sent, first in ((matching.MOST_SENT, matching.MOST_FIRST), (matching.MOST_SENT, 1), (0, 1)):
        monkeypatch.setattr(matching, "MOST_SENT", sent)
        monkeypatch.setattr(matching, "MOST_FIRST", first)
        hits = matching.found(docs, names)
        told[sent > 0, first > 1] = sorted(map(tuple, hits.collect())), hits._jdf.queryExecution().optimizedPlan().toString()
    (mine, sent), (unsifted, _), (shuffled, _) = told.values()
    assert "strategy=broadcast" in sent  # no exchange of tokens
    assert (1, "A", "North Front", 4, 6) in mine
    assert (1, "B", "Ertio", 7, 8) in mine
    assert len(mine) == 4 + 1 + 51 + 1
    assert mine == unsifted == shuffled


def test_louvain_of_many_nodes_takes_steps_by_links():
    cliques = {(a, b): 1.0 for k in range(0, 6000, 6) for a in range(k, k + 6) for b in range(a + 1, k + 6)}
    chained = cliques | {(k, k + 6): 0.5 for k in range(0, 2990, 6)} | {(7, 7): 2.0}
    began = time.process_time()
    assert graph.louvain(list(range(6000)), cliques) == {x: x - x % 6 for x in range(6000)}
    found = graph.louvain(list(range(6000)), chained)
    assert all(len({found[x] for x in range(k, k + 6)}) == 1 for k in range(0, 6000, 6))
    assert time.process_time() - began < 30  # a matrix of all nodes took minutes


def test_best_lead_is_the_first_lead_in_parts_and_rounds(spark, tmp_path):
    """Hubs whose neighbours fill several batches, links between leads, repeated links, loops, nulls and equal scores; ids far apart."""
    rng = np.random.default_rng(5)
    count = itertools.count()

    def saved(df):
        path = f"{tmp_path}/{next(count)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    for size, far, small in ((60, 2**40, 500), (300, 1, 20_000)):
        rows = [(int(a) * far, int(b) * far) for a, b in rng.integers(0, size, (size * 4, 2))]
        rows += [(-1, int(b) * far) for b in range(size)] + [(-2, int(b) * far) for b in range(1, size)] + [(None, 3), (4, None)]
        edges = spark.createDataFrame(rows, "a long, b long")
        want = {(h, n): tuple(graph.leads(edges, hub=h, least=n).orderBy(F.desc("score"), "a", "b").select("a", "b").first()) for h, n in ((20, 1), (size + 1, 2))}
        for (hub, least), pair in want.items():
            for part, multiple, batch in ((3_000_000, 3, 10_000), (small, 1, 7)):
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
                assert graph.best_lead(edges, saved, hub, least, part, multiple) == pair
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert graph.best_lead(spark.createDataFrame([(1, 1), (1, 2)], "a long, b long"), saved) is None


def test_chains_stop_where_they_cost_more_than_the_ends_found(spark):
    """A dear chain of two steps, a cheap one of four, and an end that isn't reached at all; with a small frontier and with all links."""
    links = [(1, 2, 5.0), (2, 9, 5.0), (1, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0), (5, 9, 1.0), (9, 10, 1.0), (9, 10, 3.0), (50, 51, 1.0)]
    edges = spark.createDataFrame(links, "a long, b long, cost double")
    for pins, few, want in (((1, 9, 50), 7, 1), ((1, 9, 10), 0, 3)):
        got = graph.chains_between(edges, spark.createDataFrame([(p,) for p in pins], "node long"), steps=4, hub_cost=0.25, few=few).collect()
        assert len(got) == want and [r["path"] for r in got if r["end"] == 9 and r["start"] == 1] == [[1, 3, 4, 5, 9]]


def most_rows(df):
    """The most rows that one node of a collected DataFrame's plan gave."""
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        inner = next((get for kind, get in (("AdaptiveSparkPlan", "executedPlan"), ("QueryStage", "plan")) if kind in node.nodeName()), None)
        left += [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_company_records_makes_no_pair_of_a_company_and_a_record(spark):
    """Companies of two names, records of one identifier, nulls, and a number that all companies and records have."""
    names = ["Alfa Bravo", "Bravo  Carlo", "Delta", "Echo Golf", None, ""]
    companies = [(i, names[i % 6], i % 2, "100001" if i % 3 else None, f"R{i}" if i % 50 == 0 else None) for i in range(600)]
    companies += [(7, "Delta", 0, "100001", None), (708, "India Julia", 5, None, None), (709, "Kilos", 6, "12", None), (700, "India", 5, None, None), (701, "India", 5, "100001", None), (None, "Delta", 0, "100001", "R0"), (702, "Delta", None, "100001", None)]
    records = [(f"R{i}", names[i % 5], i % 2, "100001" if i % 4 else None) for i in range(600)] + [("R1", "Delta", 0, "100001"), ("R1", "Delta", 0, "100001"), ("X1", "India Julia", 5, None), ("X2", "India", 5, None), ("X3", "India", 5, None), ("X4", "Kilos", 6, "12")]
    words = lambda name: (name or "").lower().split() or [""]
    want = {}
    for company, name, country, number, lei in companies:
        for record, of, where, its in records if company is not None else []:
            here = country == where and country is not None and name is not None and of is not None
            rank = 0 if lei == record else 1 if here and number == its and len(number or "") >= 6 and {*words(name)} & {*words(of)} else 2 if here and words(name) == words(of) and len(" ".join(words(of))) >= 5 else None
            if rank is not None:
                want.setdefault(company, {}).setdefault(rank, set()).add(record)
    want = {(c, ("lei", "registration", "name")[min(by)], ",".join(sorted(by[min(by)]))) for c, by in want.items() if min(by) < 2 or len(by[2]) == 1}
    df = matching.company_records(spark.createDataFrame(companies, "company long, name string, country long, number string, lei string"), spark.createDataFrame(records, "lei string, name string, country long, number string")).select("company", "how", "records")
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == sorted(want) and {how for _, how, _ in got} == {"lei", "registration", "name"}
    assert most_rows(df) < 2000  # 39,308 where companies meet records by number one by one


def lead_rows(df):
    return sorted(tuple(r) for r in df.select("a", "b", "shared", "score").collect())


def test_all_leads_are_the_leads_in_parts_and_rounds(spark):
    rng = np.random.default_rng(9)
    for size, far, small in ((40, 2**40, 300), (200, 1, 10_000)):
        rows = [(int(a) * far, int(b) * far) for a, b in rng.integers(0, size, (size * 4, 2))]
        rows += [(-1, int(b) * far) for b in range(size)] + [(None, 3), (4, None), (5, 5)]
        edges = spark.createDataFrame(rows, "a long, b long")
        for hub, least in ((20, 1), (size + 1, 2)):
            want = lead_rows(graph.leads(edges, hub=hub, least=least))
            assert want
            for part, multiple in ((3_000_000, 3), (small, 1)):
                assert lead_rows(graph.all_leads(edges, lambda df: keep(df, "test"), hub, least, part, multiple)) == want
    assert lead_rows(graph.all_leads(spark.createDataFrame([(1, 1), (1, 2)], "a long, b long"), lambda df: keep(df, "test"))) == []


def test_graph_leads_makes_no_pair_that_is_no_lead(spark):
    df = QUERIES["graph_leads"](spark, "/root/testdata/sf0.001")
    assert most_rows(df) <= 0 < len(rows := df.collect()) and most_rows(df) <= len(rows)  # wedges were rows of the plan


def test_named_leads_are_those_of_the_rule_in_parts_and_rounds(spark):
    """Nodes of two kinds, of none and of no row, tools, hubs, links between ends, repeats, loops and nulls; names of any length."""
    rng = np.random.default_rng(3)
    node = lambda i: f"{'xyz'[i % 3] * (i % 4 + 1)}{i}"
    rows = [(node(int(a)), node(int(b))) for a, b in rng.integers(0, 60, (300, 2))] + [("hub", node(b)) for b in range(60)] + [(None, node(1)), (node(2), None), (node(3), node(3))]
    kinds = [(node(i), ("actor", "place", "tool", None)[i * 7 % 4]) for i in range(55)] + [(node(0), "place"), (node(2), "actor"), (node(14), "actor"), ("hub", "place"), ("alone", "actor"), (node(0), "actor")]
    together = [tuple(sorted((node(a), node(b)))) for a in range(0, 60, 4) for b in range(0, 60, 12) if a != b]
    near = {}
    for a, b in rows:
        if a and b and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    ends, via = {n for n, k in kinds if k == "actor"}, {n for n, k in kinds if k not in ("tool", None)}
    edges = spark.createDataFrame(rows, "a string, b string")
    frames = spark.createDataFrame(kinds, "node string, kind string"), spark.createDataFrame(together, "a string, b string")
    for hub, least, part, multiple in ((200, 1, 3_000_000, 3), (12, 2, 40, 1)):
        met = {}
        for w in via & near.keys():
            for a, b in itertools.combinations(sorted(near[w] & ends), 2) if 2 <= len(near[w]) <= hub else []:
                met.setdefault((a, b), []).append(1 / np.log(len(near[w])))
        want = [(*p, len(v), round(sum(v), 6)) for p, v in sorted(met.items()) if len(v) >= least and p[1] not in near[p[0]] and p not in together]
        got = lead_rows(graph.named_leads(edges, *frames, ["actor"], ["tool"], lambda df: keep(df, "test"), hub, least, part, multiple))
        assert want and [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], atol=1.1e-6)


def test_supplier_leads_makes_no_pair_that_is_no_lead(spark):
    df = QUERIES["supplier_leads"](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    assert rows and most_rows(df) <= 1000  # the rows of names; links were 6,000 rows of the plan, and wedges more
