"""The pipeline against a plain version of its stages."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import mixing, packing
from quillon.llm.tokens import default_path
from tests.llm.test_operators import brute_components, brute_counts, brute_secrets, brute_targets, split, words


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = [words(int(rng.integers(60, 200)), i) for i in range(60)]
    texts += [texts[3], texts[5] + " more", "short one", None, "token=abcdefgh12 " + words(70, 99)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {i for i, t in enumerate(texts) if (n := brute_counts(t))[0] >= 50 and 100 * n[4] <= 50 * n[0]}
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules_stage(spark, docs, str(tmp_path)).collect()} == kept
    order = sorted(kept)
    _, label = brute_components([texts[i] for i in order])
    kept = {order[k] for k in set(label)}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in now.collect()}
    assert set(left) == kept and not any(brute_secrets(t)[0] for t in left.values())
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # mixing: copies by rate and the hash of the id; packing: pieces of the ids, best-fit decreasing
    source = {i: f"s{i % 3}" for i in left}
    sizes = Counter()
    for i, t in left.items():
        sizes[source[i]] += len(split(t))
    target = brute_targets(sizes)
    copies = {}
    for i in left:
        rate = target[source[i]] / sizes[source[i]]
        draw = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        copies[i] = math.floor(rate) + (draw < rate - math.floor(rate))
    tokenizer = Tokenizer.from_file(default_path())
    want = Counter()
    for i, n in copies.items():
        ids = np.array([*tokenizer.encode(left[i], add_special_tokens=False).ids, 0], dtype="<u4")
        for k, (start, length) in enumerate(packing.cut(len(ids), 2048)):
            want[i, k, start, length, zlib.crc32(ids[start : start + length].tobytes())] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in result) == +want
    room: list[int] = []
    for length in sorted((k[3] for k, n in want.items() for _ in range(n)), reverse=True):
        fit = [i for i, left_over in enumerate(room) if left_over >= length]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= length
        else:
            room.append(2048 - length)
    held: dict = {}
    for r in result:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(held) == len(room)
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
