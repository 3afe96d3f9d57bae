"""Operators without SQL against brute-force versions on small data."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import graph, matching, names, stores, text
from quillon.streaming import updates


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components_of_a_long_chain(spark):
    spark.sparkContext.setCheckpointDir("/tmp/quillon-test-checkpoints")
    chain = [(0, 150), *((i, i - 1) for i in range(150, 1, -1)), (200, 201), (5, 5)]
    got = {r["node"]: (r["component"], r["size"]) for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: (0, 151) for i in range(151)}, 200: (200, 2), 201: (200, 2)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_chain(edges, start, end, steps, hub=0.5):
    near = {}
    for a, b, c in edges:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = min(c, near.get(x, {}).get(y, math.inf))
    best = None

    def walk(at, path, cost):
        nonlocal best
        for y, c in near.get(at, {}).items():
            if y in path:
                continue
            total = cost + c
            if y == end:
                key = (round(total, 6), len(path) + 1, [*path, y])
                best = key if best is None or key < best else best
            elif len(path) < steps:
                walk(y, [*path, y], total + hub * math.log2(1 + len(near[y])))

    walk(start, [start], 0.0)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_chains_between_pins(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, 14, 24), rng.integers(0, 14, 24), rng.choice([1.0, 1.25, 1.75], 24), strict=True) if a != b]
    pins = [0, 3, 7, 13]
    df = spark.createDataFrame(edges, "a long, b long, cost double")
    got = {(r["start"], r["end"]): r["cost"] for r in graph.chains_between(df, spark.createDataFrame([(p,) for p in pins], "node long"), steps=4).collect()}
    want = {(a, b): brute_chain(edges, a, b, 4) for a, b in combinations(pins, 2)}
    assert got == {k: v[0] for k, v in want.items() if v}
    grid, connectors = graph.case_file(df, spark.createDataFrame([(p,) for p in pins], "node long"), steps=4)
    inner = Counter(n for r in grid.collect() for n in r["path"][1:-1] if n not in pins)
    assert rows(connectors) == sorted((n, k) for n, k in inner.items() if k >= 2)


def test_alternatives_share_no_inner_node(spark):
    edges = [("s", "a", 1.0), ("a", "t", 1.0), ("s", "b", 1.0), ("b", "c", 1.0), ("c", "t", 1.0), ("s", "t", 1.0), ("x", "y", 1.0)]
    df = spark.createDataFrame(edges, "a string, b string, cost double")
    assert [p for p, _ in graph.alternatives(df, "s", "t", k=5)] == [["s", "t"], ["s", "a", "t"], ["s", "b", "c", "t"]]
    assert graph.alternatives(df, "s", "x") == []


def modularity(weights, member):
    m2 = 2 * sum(weights.values())
    degree = Counter()
    for (a, b), w in weights.items():
        degree[a] += w
        degree[b] += w
    inside = sum(2 * w for (a, b), w in weights.items() if member[a] == member[b]) / m2
    total = Counter()
    for n, d in degree.items():
        total[member[n]] += d
    return inside - sum((t / m2) ** 2 for t in total.values())


def test_communities_and_clusters():
    two = {(1, 2): 1.0, (2, 3): 1.0, (1, 3): 1.0, (4, 5): 1.0, (5, 6): 1.0, (4, 6): 1.0, (3, 4): 0.1}
    assert graph.louvain([1, 2, 3, 4, 5, 6, 7], two) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7}
    rng = np.random.default_rng(2)
    weights = {(a, b): float(rng.integers(1, 4)) for a, b in combinations(range(12), 2) if rng.random() < (0.8 if a // 4 == b // 4 else 0.1)}
    found = graph.louvain(list(range(12)), weights)
    assert modularity(weights, found) >= modularity(weights, {i: i // 4 for i in range(12)}) - 1e-9
    assert graph.louvain([], {}) == {}

    def brute(keys, near, threshold):
        groups = [[k] for k in keys]
        mean = lambda g, h: sum(near.get((a, b), near.get((b, a), 0.0)) for a in g for b in h) / (len(g) * len(h))
        while len(groups) > 1:
            s, g, h = max(((mean(g, h), g, h) for g, h in combinations(groups, 2)), key=lambda x: x[0])
            if s < threshold:
                break
            groups = [x for x in groups if x is not g and x is not h] + [g + h]
        return sorted(sorted(g) for g in groups)

    for seed in range(5):
        near = {p: float(v) for p, v in zip(combinations("abcdefgh", 2), np.random.default_rng(seed).random(28), strict=True)}
        assert sorted(sorted(g) for g in graph.cluster(list("abcdefgh"), near, 0.5)) == brute("abcdefgh", near, 0.5)


def test_slots_keep_order_and_distance():
    got = graph.slots([10.0, 12.0, 11.0, 200.0], 5.0)
    assert got == [6.0, 16.0, 11.0, 200.0]


@pytest.mark.parametrize("seed", range(3))
def test_identities_follow_edges_in_order(spark, seed):
    rng = np.random.default_rng(seed)
    lists = ["UN", "EU", "US"]
    entries = [(i, i, lists[int(rng.integers(3))], "person", f"Name {'AB'[int(rng.integers(2))]} {'CD'[int(rng.integers(2))]}", str(100_000 + int(rng.integers(6))) if rng.random() < 0.5 else None, int(rng.integers(20)) if rng.random() < 0.2 else None, f"19{int(rng.integers(60, 63))}-01-01") for i in range(20)]
    df = spark.createDataFrame(entries, "id long, place long, list string, type string, name string, number string, reference long, birth string")
    edges = matching.identity_edges(df).collect()
    group = {e[0]: {e[0]} for e in entries}
    of = {e[0]: e[2] for e in entries}
    for r in sorted(edges, key=lambda r: (r["rule"], r["place"], r["a"])):
        x, y = group[r["a"]], group[r["b"]]
        if x is not y and not {of[i] for i in x} & {of[i] for i in y}:
            x |= y
            for i in y:
                group[i] = x
    part = lambda e: graph.components(e)
    got = {r["id"]: r["subject"] for r in matching.identities(df, spark.createDataFrame(edges, matching.identity_edges(df).schema), part).collect()}
    assert got == {i: min(g) for i, g in group.items()}


def brute_sentences(units, k=3, rounds=30):
    out = []
    for unit, sentences in units.items():
        fit = [(i + 1, s) for i, s in enumerate(sentences) if 8 <= len(s.split()) <= 60]
        n = len(fit)
        if n > text.SENTENCES:
            fit = [fit[j * n // text.SENTENCES] for j in range(text.SENTENCES)]
        bags = [{w for w in s.lower().split() if len(w) >= 3 and w not in text.STOP} for _, s in fit]
        weight = [[len(a & b) / (math.log(len(a)) + math.log(len(b))) if i != j and len(a) > 1 and len(b) > 1 else 0.0 for j, b in enumerate(bags)] for i, a in enumerate(bags)]
        total = [sum(r) or 1.0 for r in weight]
        score = [1.0] * len(fit)
        for _ in range(rounds):
            score = [0.15 + 0.85 * sum(weight[j][i] / total[j] * score[j] for j in range(len(fit))) for i in range(len(fit))]
        best = sorted(range(len(fit)), key=lambda i: (-round(score[i], 6), fit[i][0]))[:k]
        out += [(unit, fit[i][0], round(score[i], 4)) for i in best]
    return sorted(out)


def test_key_sentences(spark):
    rng = np.random.default_rng(4)
    pool = [f"word{chr(97 + i)}" for i in range(26)]
    units = {1: [" ".join(rng.choice(pool, rng.integers(5, 14))) for _ in range(30)], 2: [" ".join(rng.choice(pool, 8)) for _ in range(text.SENTENCES + 57)], 3: ["too short"]}
    df = spark.createDataFrame([(u, i + 1, s) for u, ss in units.items() for i, s in enumerate(ss)], "unit long, place int, sentence string")
    assert [(u, p, round(s, 4)) for u, p, _, s in rows(text.key_sentences(df))] == brute_sentences(units)
    assert text.central_candidates(df).filter("unit = 2").count() == text.SENTENCES


def test_name_matches_and_pairs(spark):
    docs = [(1, "The Grey Wolf met Bear. Grey Wolf Pack left; bear " + "x " * 400 + "Bear"), (2, "WOLF and Grey"), (3, None), (4, "")]
    known = [("a", "Grey Wolf"), ("a", "Wolf"), ("b", "Grey Wolf Pack"), ("c", "Bear")]
    got = names.match(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(known, "actor string, name string"))
    want = []
    for doc_id, t in docs:
        words, at = [], 0
        for w in (t or "").replace(".", " ").replace(";", " ").split(" "):
            if w:
                words.append((w, at))
            at += len(w) + 1
        i = 0
        while i < len(words):
            hits = sorted(((len(n.split()), a, n) for a, n in known if [w for w, _ in words[i : i + len(n.split())]] == n.split()), reverse=True)
            if hits:
                k, a, n = hits[0]
                want.append((doc_id, a, n, words[i][1], words[i + k - 1][1] + len(words[i + k - 1][0])))
                i += k
            else:
                i += 1
    assert rows(got) == sorted(want)
    marks = [(d, a, s) for d, a, _, s, _ in want]
    pairs = Counter()
    for d, a, s in marks:
        pairs.update({(d, *sorted((a, b))) for e, b, t in marks if e == d and b != a and (0 < t - s <= 600)})
    assert rows(names.pairs(got)) == sorted((*k, n) for k, n in pairs.items())
    with pytest.raises(ValueError, match="matching.found"):
        names.MOST_NAMES, kept = 2, names.MOST_NAMES
        try:
            names.match(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(known, "actor string, name string"))
        finally:
            names.MOST_NAMES = kept


def test_guarded_names(spark):
    table = spark.createDataFrame([("p", "Ford", True, True), ("q", "Lazarus", True, False), ("r", "Hidden Cobra", False, False), ("s", "Mint", False, False)], "actor string, name string, manual boolean, person boolean").withColumn("tokens", matching.name_tokens(F.col("name")))
    docs = spark.createDataFrame([(1, "USS Ford sailed"), (2, "Ford spoke"), (3, "Ford Airport"), (4, "Lazarusem and Lazarusexyz"), (5, "HIDDEN COBRA struck"), (6, "Mint is a herb"), (7, "hackers of Mint struck")], "doc_id long, text string")
    assert [(r[0], r[1]) for r in rows(matching.found(docs, table, {"Mint": ["hack"]}))] == [(2, "p"), (4, "q"), (5, "r"), (7, "s")]


def test_long_document_stays_linear(spark):
    docs = spark.createDataFrame([(1, "word " * 60_000 + "Grey Wolf")], "doc_id long, text string")
    table = spark.createDataFrame([("a", "Grey Wolf", False, False)], "actor string, name string, manual boolean, person boolean").withColumn("tokens", matching.name_tokens(F.col("name")))
    assert rows(matching.found(docs, table)) == [(1, "a", "Grey Wolf", 60_000, 60_002)]


def test_committed_parts(spark, tmp_path):
    df = spark.range(90).withColumn("x", F.col("id") * 2)
    parts = updates.committed(df, f"{tmp_path}/t", 25)
    assert 1 <= len(parts) <= 4 and rows(spark.read.parquet(f"{tmp_path}/t").select("id", "x")) == [(i, 2 * i) for i in range(90)]


def test_store_helpers(spark, tmp_path):
    (tmp_path / "kev.json").write_text('{"items": [{"id": "CVE-1", "year": 2020}, {"id": "CVE-2", "year": 2021}]}')
    assert rows(stores.json_records(spark, f"{tmp_path}/kev.json", "id string, year int", "items")) == [("CVE-1", 2020), ("CVE-2", 2021)]
    assert stores.link_of({"country": "CZ", "lang": "", "year": 2020}) == "/documents?country=CZ&year=2020"
    kept = stores.restored({"a": spark.range(3), "b": spark.range(2)}, {"a": F.col("id") == 1})
    assert kept["a"].count() == 2 and kept["b"].count() == 2
    assert '"share": 0.5' in stores.progress_line("index", 1, 2)


def test_all_codes_of_a_text_count(spark):
    from quillon.operators import links

    t = " ".join(f"CVE-2020-{1000 + i % 30}" for i in range(900))
    got = links.code_marks(spark.createDataFrame([(1, t), (2, None), (3, "cve–2019–1234, CVE-1998-1111")], "doc_id long, text string"), 2025).collect()
    assert sorted((r["doc_id"], r["code"], r["n"], r["first"], len(r["places"])) for r in got) == sorted([(1, f"CVE-2020-{1000 + i}", 30, 14 * i, 20) for i in range(30)] + [(3, "CVE-2019-1234", 1, 0, 1)])
