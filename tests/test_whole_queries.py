"""Queries without SQL on small tables, against brute force over all of their rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np

from quillon.plans import QUERIES


def tables(spark, folder, **held):
    for name, (data, schema) in held.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def lines(spark, folder):
    """A folder of orders and lines of all quantities, and the ties between customers and parts with their layers."""
    rng = np.random.default_rng(3)
    orders = [(i, int(rng.integers(1, 9)), f"{i % 4}-LAYER") for i in range(30)]
    held = [(int(rng.integers(30)), int(rng.integers(1, 15)), float(rng.integers(1, 51))) for _ in range(45)]
    layers = defaultdict(set)
    for order, part, _ in held:
        layers[orders[order][1] * 2, part * 2 + 1].add(orders[order][2])
    near = defaultdict(set)
    for a, b in layers:
        near[a].add(b)
        near[b].add(a)
    sf = tables(spark, folder, orders=(orders, "o_orderkey long, o_custkey long, o_orderpriority string"), lineitem=(held, "l_orderkey long, l_partkey long, l_quantity double"))
    return sf, layers, near


def test_graph_path_is_over_all_lines(spark, tmp_path):
    sf, _, near = lines(spark, tmp_path)
    shared = {(a, b): sum(1 / math.log(len(near[w])) for w in near[a] & near[b] if len(near[w]) > 1) for a in near for b in near if a < b and b not in near[a] and near[a] & near[b]}
    start, end = min(shared, key=lambda p: (-round(shared[p], 6), p))
    costs = {}

    def walk(path, cost):
        if path[-1] == end:
            costs[">".join(map(str, path))] = cost
        elif len(path) <= 6:
            for n in near[path[-1]] - set(path):
                walk([*path, n], cost + 1 + (0 if n == end else 0.5 * math.log2(1 + len(near[n]))))

    walk([start], 0.0)
    got = QUERIES["graph_path"](spark, sf).first()
    assert got["cost"] == round(min(costs.values()), 6) == round(costs[got["path"]], 6)


def test_graph_rings_are_over_all_lines(spark, tmp_path):
    sf, layers, near = lines(spark, tmp_path)
    center = min(near, key=lambda n: (-len(near[n]), n))
    want = {(1, n, float(len(layers.get((center, n), layers.get((n, center)))))) for n in near[center]}
    for n in set().union(*(near[w] for w in near[center])) - near[center] - {center}:
        want.add((2, n, round(len(near[n] & near[center]) / (1 + 0.5 * math.log2(len(near[n]))), 6)))
    assert {tuple(r) for r in QUERIES["graph_rings"](spark, sf).collect()} == want


def brute_rank(sentences):
    """Scores by plain sums over pairs."""
    bags = [set(s.lower().strip(".").split()) for s in sentences]
    n = len(bags)
    size = [math.log(len(b)) for b in bags]
    w = [[0.0 if i == j or len(bags[i]) < 2 or len(bags[j]) < 2 else len(bags[i] & bags[j]) / (size[i] + size[j]) for j in range(n)] for i in range(n)]
    out = [sum(r) or 1 for r in w]
    score = [1.0] * n
    for _ in range(30):
        share = [x / o for x, o in zip(score, out, strict=True)]
        score = [0.15 + 0.85 * sum(a * b for a, b in zip(w[i], share, strict=True)) for i in range(n)]
    return score


def test_key_sentences_are_sampled_evenly_over_the_whole_unit(spark, tmp_path):
    """Short and very long sentences, tables and references are left out; of more than 400 every n-th counts, to the end."""
    rng = np.random.default_rng(1)
    word = lambda: "".join("bcdfgk"[i] for i in rng.integers(0, 6, 3))
    odd = ["too short here.", "See https://a.example/x and https://b.example/y and other places that are listed here.", "Row 12 34 56 78 90 12 34 56 78 90 12."]
    said = {c: [odd[i % 3] if i % 9 == 4 else " ".join(word() for _ in range(rng.integers(8, 13))) + "." for i in range(n)] for c, n in ((1, 900), (2, 440), (3, 460), (4, 2))}
    turns = [(c, t, "user", " ".join(s[t * 10 : t * 10 + 10])) for c, s in said.items() for t in range(-(-len(s) // 10))]
    sf = tables(spark, tmp_path, conversations=(turns, "conv_id long, turn int, role string, text string"))
    got = defaultdict(dict)
    for r in QUERIES["key_sentences"](spark, sf).collect():
        assert r["sentence"] == said[r["unit"]][r["place"] - 1]
        got[r["unit"]][r["place"]] = r["score"]
    assert set(got) == set(said)
    for c, found in got.items():
        fit = [i for i in range(len(said[c])) if i % 9 != 4]
        kept = [fit[j * len(fit) // 400] for j in range(400)] if len(fit) > 400 else fit
        score = dict(zip(kept, brute_rank([said[c][i] for i in kept]), strict=True))
        top = sorted(score.values(), reverse=True)[:3]
        assert len(found) == len(top) and np.allclose(sorted(found.values(), reverse=True), top, atol=2e-6)
        assert all(abs(score[p - 1] - s) < 2e-6 for p, s in found.items())


def test_name_mentions_leave_out_ordinary_words(spark, tmp_path):
    texts = {1: "The Eriner met the eriner. Eriner", 2: "Of the And and and Que", 3: "In Ofonrereer, In. With the Les les", 4: None, 5: "Der Eriner Les", 6: "In in", 7: "With the And and"}
    gazetteer = {"The": "a1", "Of the": "a1", "And": "a2", "In": "a3", "Der": "a4", "Les": "a5", "Que": "a6", "With the": "a2", "Eriner": "a7", "Ofonrereer": "a8"}
    found = {i: re.findall(r"\w+", t or "") for i, t in texts.items()}
    uses = Counter(w for words in found.values() for w in words)
    ordinary = {n for n in gazetteer if uses[n.lower()] > uses[n]}
    assert ordinary == {"The", "And"}
    want = set()
    for i, words in found.items():
        hits = defaultdict(list)
        for at in range(len(words)):
            for name in {" ".join(words[at : at + 2]), words[at]}:
                if name in gazetteer and name not in ordinary:
                    hits[gazetteer[name]].append(name)
        want |= {(i, a, len(n), len(set(n))) for a, n in hits.items() if set(n) != {"In"}}
    sf = tables(spark, tmp_path, documents=(list(texts.items()), "doc_id long, text string"))
    assert {tuple(r) for r in QUERIES["name_mentions"](spark, sf).collect()} == want
