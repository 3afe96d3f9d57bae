"""The corpus operators on very long texts, empty tables and clashing columns, and the classifier against plain algebra."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import chat, html_text, packing, quality_model, quality_rules, secret_scan, suffix_dedup, topk
from quillon.llm.tokens import default_path, encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SLOW = 60  # seconds on a loaded machine; each of these was out of reach or quadratic once


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def in_time(act):
    began = time.perf_counter()
    out = act()
    assert time.perf_counter() - began < SLOW
    return out


def test_long_white_space_is_encoded_as_by_tokenizers(spark):
    from tokenizers import Tokenizer

    encode = encoder({"file": open(default_path(), encoding="utf-8").read()})
    plain = Tokenizer.from_file(default_path())
    rng = random.Random(1)
    mixed = "".join(rng.choice(" \t\n　\u0085") for _ in range(3_000))
    for t in (" " * 600, " " * 600 + "a", "x" + "\n" * 5_000 + " y", mixed + "b", "a" * 20_000, "." * 5_000, "1" * 5_000, "a\x1c" * 600):
        assert encode(t) == plain.encode(t, add_special_tokens=False).ids
    got = in_time(lambda: packing.pack(docs_of(spark, [" " * 1_000_000, "\n" * 1_000_000, "a" * 5_000_000])).groupBy("doc_id").agg(F.sum("length").alias("n")).collect())
    assert {r["doc_id"]: r["n"] for r in got if r["doc_id"] < 2} == {0: 1_000_001, 1: 500_001}


def test_long_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "<|" * 300_000), (1, 1, "assistant", " " * 1_000_000), (1, 2, "assistant", "a" * 2_000_000)], "conv_id long, turn long, role string, text string")
    r = in_time(lambda: chat.read_back(chat.format_windows(turns)).first())
    said = " " * 1_000_000 + "a" * 2_000_000
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (3, len(said), hashlib.sha256(said.encode()).hexdigest())
    empty = turns.filter("false")
    assert chat.read_back(chat.format_windows(empty)).count() == 0


def test_many_secrets(spark):
    texts = ["token=abcdef1 " * 20_000, "".join(random.Random(2).choice("0123456789abcdef") for _ in range(50_000)), "a" * 5_000_000, " " * 5_000_000]
    got = in_time(lambda: {r["doc_id"]: r for r in secret_scan.find_secrets(docs_of(spark, texts)).collect()})
    assert (got[0]["n_assign"], got[1]["n_hex"], got[2]["n_hex"], got[3]["spans"]) == (20_000, 1, 1, "")
    clean = in_time(lambda: {r["doc_id"]: r["text"] for r in secret_scan.redact(docs_of(spark, texts)).collect()})
    assert clean[0] == "[SECRET] " * 20_000 and clean[1] == "[SECRET]" and clean[3] == texts[3]


def brute_entropy(text, kind, order):
    pattern, bits = secret_scan.CLASSES[kind]
    w, out = secret_scan.WINDOW, []
    for m in re.finditer(pattern, text):
        if any(re.search(a, m[0]) for a in secret_scan.ALLOW):
            continue
        hot = [i for i in range(len(m[0]) - w + 1) if -sum(c / w * math.log2(c / w) for c in Counter(m[0][i : i + w]).values()) >= bits - 1e-12]
        for i in hot:
            if out and out[-1][1] == order and out[-1][2] >= m.start() + i and out[-1][0] >= m.start():
                out[-1][2] = m.start() + i + w
            else:
                out.append([m.start() + i, order, m.start() + i + w])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(3))
def test_added_spans_are_those_of_a_plain_scan(spark, seed):
    rng = random.Random(seed)
    letters = {"entropy_hex": "0123456789abcdefABCDEF", "entropy_token": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"}
    texts = []
    for _ in range(12):
        parts = []
        for _ in range(6):
            some = letters[rng.choice(list(letters))]
            parts.append("".join(rng.choice(some[: rng.randint(2, len(some))]) for _ in range(rng.randint(10, 70))))
        texts.append(" é ".join(parts))
    for r in secret_scan.find_secrets(docs_of(spark, texts)).collect():
        own = {tuple(x.rsplit(":", 2)) for x in r["spans"].split(",") if x.startswith("entropy")}
        want = {(secret_scan.KINDS[k], str(a), str(b)) for kind in secret_scan.CLASSES for a, k, b in brute_entropy(texts[r["doc_id"]], kind, secret_scan.KINDS.index(kind))}
        assert own == want


def test_one_letter_texts_are_removed(spark):
    texts = ["a" * 300_000, "b" * 399, "b" * 400, "c" * 800]
    got = in_time(lambda: {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs_of(spark, texts)).collect()})
    assert [(got[i]["n_removed"], got[i]["n_spans"]) for i in range(4)] == [(300_000, 1), (0, 0), (0, 0), (800, 1)]


def test_deep_and_broken_markup(spark):
    pages = ["<a " * 300_000, "<div>" * 100_000 + "deep text", "<header>" * 50_000 + "x", "<div>" * 30_000 + "<p>q</p>" * 30_000, "<div>" * 20_000 + "</b></section>" * 20_000 + "y", "z" * 5_000_000, "<!--" * 100_000]
    df = spark.createDataFrame([(i, "http://h.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = in_time(lambda: {r["page_id"]: r for r in html_text.extract(df).collect()})
    assert got[1]["text"] == "deep text" and got[5]["n_chars"] == 5_000_000 and got[3]["text"] == " ".join("q" * 30_000) and got[6]["text"] == ""


def made_page(rng):
    """A page of known main text: boilerplate of all kinds round an article or a container."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    blocks, text = [], []
    for _ in range(rng.randint(3, 8)):
        a, b = line(rng.randint(8, 30)), line(3)
        kind = rng.choice(["<p>{a} <b>{b}</b></p>", "<h2>{a}</h2><p>{b}</p>", "<ul><li>{a}<li>{b}</ul>", "<p>{a}<br>{b}</p>", "<blockquote>{a}</blockquote><p>{b} &amp; c</p>"])
        blocks.append(kind.format(a=a, b=b))
        text.append(f"{a} {b}" + (" & c" if "&amp;" in kind else ""))
    noise = [f"<nav><a href='/x'>{line(4)}</a></nav>", f"<div class='sidebar'>{line(6)}</div>", f"<footer>{line(5)}</footer>", f"<script>var x = '{line(4)}'</script>", f"<!-- {line(3)} -->", f"<div class='ad'>{line(5)}</div>", f"<form><input value='q'>{line(2)}</form>", f"<div id='comments'><p>{line(9)}</p></div>"]
    rng.shuffle(noise)
    open_, close = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>")])
    return f"<html><head><title>{line(3)}</title><style>p{{}}</style></head><body>{''.join(noise[:4])}{open_}{''.join(blocks)}{close}{''.join(noise[4:])}</body></html>", " ".join(text)


def test_made_pages_give_back_their_article(spark):
    rng = random.Random(5)
    made = [made_page(rng) for _ in range(60)]
    rows = [(i, f"https://www.h{i % 4}.example/p/{i}" if i % 9 else None, html, 1, "clash") for i, (html, _) in enumerate(made)]
    rows += [rows[3], (None, "x", None, 1, "c"), (None, None, "", 1, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host long, __path string")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows) and sorted(r["n_chars"] for r in got if r["page_id"] is None) == [0, 0]
    for r in got:
        if r["page_id"] is not None:
            assert r["text"] == made[r["page_id"]][1]
    assert html_text.extract(pages.filter("false")).count() == 0


def test_large_path_tables_are_joined(spark, monkeypatch):
    rng = random.Random(6)
    made = [made_page(rng) for _ in range(12)]
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.example/", html) for i, (html, _) in enumerate(made)], "page_id long, url string, html string")
    sent = sorted(map(tuple, html_text.extract(pages).collect()))
    monkeypatch.setattr(html_text, "SENT", -1)
    assert sorted(map(tuple, html_text.extract(pages).collect())) == sent


def test_scores_are_those_of_plain_algebra(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["alpha", "beta#", "GAMMA", "delta.", "x1", "\n"]) for _ in range(rng.randint(0, 80))) for _ in range(240)]
    docs, labels = docs_of(spark, texts), spark.createDataFrame([(i, int(len(t) > 150)) for i, t in enumerate(texts) if i % 3] + [(None, 1), (5, 9)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_model.score_quality(docs, labels).collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in got}
    assert all(r["held_out"] == (fold[i] == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items())
    x = {r["doc_id"]: np.array(r["__x"]) for r in quality_model.statistics(docs).collect()}
    y = {i: float(len(texts[i]) > 150) for i in got if i % 3}
    known = [i for i in got if i in y and fold[i] != 0]
    everything = np.stack([x[i] for i in known])
    spread = everything.std(0)
    spread[spread < 1e-9] = 1.0
    gen, dims, k = np.random.default_rng(quality_model.SEED), everything.shape[1], quality_model.FOURIER
    model = {"mean": everything.mean(0), "spread": spread, "w": gen.normal(size=(dims, k)) / math.sqrt(dims), "b": gen.uniform(0, 2 * math.pi, k)}
    fitted = [i for i in known if fold[i] != 1]
    z, t = quality_model.features(model, np.stack([x[i] for i in fitted])), np.array([y[i] for i in fitted])
    beta = np.linalg.solve(z.T @ z + quality_model.RIDGE * len(t) * np.eye(z.shape[1]), z.T @ t)
    raw = dict(zip(got, quality_model.features(model, np.stack([x[i] for i in got])) @ beta, strict=True))
    assert max(abs(raw[i] - got[i]["raw"]) for i in got) < 1e-6
    order = sorted(got, key=lambda i: got[i]["raw"])
    scores = [got[i]["score"] for i in order]
    assert all(b >= a - 1e-9 for a, b in zip(scores, scores[1:], strict=False))


def test_empty_tables(spark):
    docs, labels = docs_of(spark, []), spark.createDataFrame([], "doc_id long, quality int")
    assert quality_model.score_quality(docs, labels).count() == 0
    assert quality_rules.judge(docs, labels).count() == 0 and quality_rules.keep_good(docs, labels).count() == 0
    assert secret_scan.find_secrets(docs).count() == 0 and secret_scan.redact(docs).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0


def test_clashing_columns(spark):
    taken = ["__text", "__base", "__all", "__clean", "__mix_size", "__mix_source", "__mix_total", "__mix_n", "__mix_copy", "__verdict_id", "__gone", "_weight", "copies"]
    docs = docs_of(spark, ["token=abcdef1 and " + "some plain words " * 30, None, ""]).withColumns({c: F.lit(f"kept {c}") for c in taken})
    from quillon.llm import mixing, shingle_join

    for act in (secret_scan.redact, mixing.mix_sources, shingle_join.keep_one_each, lambda d: quality_rules.keep_good(d, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))):
        out = act(docs)
        assert out.columns == docs.columns
        assert all(r[c] == f"kept {c}" for r in out.collect() for c in taken)
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)], "c", 1) for i in range(45)], "vec_id long, embedding array<float>, score string, rank long")
    best = {(r["query_id"], r["rank"]): r["vec_id"] for r in topk.top_k(vectors).collect()} if hasattr(topk, "top_k") else {}
    assert all(q != v for (q, _), v in best.items())


def test_pipeline_stages_on_empty_documents(spark, tmp_path):
    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
