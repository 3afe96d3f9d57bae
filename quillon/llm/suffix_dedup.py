"""Removal of byte strings that repeat anywhere, by range-partitioned and locally sorted suffixes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.components import filter_bits, in_filter
from quillon.llm.rolling import Powers, sliding_min
from quillon.llm.storage import discard, materialize, table

LENGTH = 400
#: Suffixes are sorted where they start at the least of all LEAD-byte hashes of some LENGTH-byte window: two equal
#: windows pick the same place, so nothing is lost, and one in about (LENGTH - LEAD) / 2 suffixes is left.
LEAD = 100
BUCKET_ROWS = 20_000
#: Surroundings that a task remembers so as to send equal ones twice at most.
SEEN = 500_000
#: Leads that occur more often are not sorted in one task, which would hold some 3 KB for each occurrence: their windows are
#: counted by hashes, STEP offsets at a time first.
HOT_LEAD = 200_000
STEP = 10
_BATCH = 1 << 19  # bytes hashed at once; places take 20 bits


def _segments(texts, length: int):
    """(row, start, bytes) of at most _BATCH bytes each, overlapping by length - 1, in lists of at most _BATCH bytes."""
    held, size = [], 0
    for row, data in enumerate(texts):
        start = 0
        while len(data) - start >= length:
            part = data[start : start + _BATCH]
            if size + len(part) > 2 * _BATCH - 1:
                yield held
                held, size = [], 0
            held.append((row, start, part))
            size += len(part)
            if start + len(part) >= len(data):
                break
            start += len(part) - length + 1
    if held:
        yield held


def anchors(texts, length: int = LENGTH, lead: int = LEAD):
    """For bytes of documents: arrays row, place, hash of the lead, for every place that a window picks (its leftmost
    least hash), each place once."""
    import numpy as np

    powers, low = Powers(), np.uint64((1 << 20) - 1)
    last = (-1, -1)
    for held in _segments(texts, length):
        data = np.frombuffer(b"".join(p for _, _, p in held), dtype=np.uint8)
        hashes = powers.windows(powers.prefix(data), lead)
        least = sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - lead + 1)
        ends = np.cumsum([len(p) for _, _, p in held])
        begins = ends - [len(p) for _, _, p in held]
        picked = [np.unique(least[b : e - length + 1] & low).astype(np.int64) for b, e in zip(begins, ends, strict=True)]
        for i, ((row, start, _), b) in enumerate(zip(held, begins, strict=True)):
            if (row, picked[i][0] - b + start) == last:  # picked by the last windows of the segment before, too
                picked[i] = picked[i][1:]
            if len(picked[i]):
                last = (row, picked[i][-1] - b + start)
        counts = [len(p) for p in picked]
        place = np.concatenate(picked)
        rows = np.repeat([r for r, _, _ in held], counts)
        shift = np.repeat(begins - [s for _, s, _ in held], counts)
        yield rows, place - shift, hashes[place].astype(np.int64)


def _texts(batches, width: int = 512):
    for batch in batches:
        for at in range(0, batch.num_rows, width):
            part = batch.slice(at, width)
            yield part, [(t or "").encode() for t in part.column(2).to_pylist()]


def multikey_sort(words):
    """Order of rows of big-endian words, and for each row how many leading words it shares with the row before.

    Multikey quicksort, all groups at once: rows are sorted by a word, and those equal in it go on to the next word.
    """
    import numpy as np

    n, width = words.shape
    order = np.arange(n)
    shared = np.zeros(n, dtype=np.int64)
    lo = np.zeros(n, dtype=np.int64)  # group of each place of `order`: the place where it begins
    active = np.arange(n)
    for d in range(width):
        if not len(active):
            break
        column = words[order[active], d]
        perm = np.lexsort((column, lo[active]))
        order[active] = order[active][perm]
        column = column[perm]
        same = np.zeros(len(active), dtype=bool)
        same[1:] = (column[1:] == column[:-1]) & (lo[active][1:] == lo[active][:-1])
        shared[active[same]] = d + 1
        begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(active))))
        lo[active] = active[begin]
        more = same.copy()
        more[:-1] |= same[1:]
        active = active[more]
    return order, shared


def _sorted_common(padded, sizes):
    """Order of byte rows and the bytes that each shares with the row before in it (no further than either's size)."""
    import numpy as np

    n, width = padded.shape
    words = np.ascontiguousarray(padded).view(">u8").astype(np.uint64)
    words = np.concatenate([words, sizes[:, None].astype(np.uint64)], axis=1)  # equal but for padding: shorter first
    order, shared = multikey_sort(words)
    common = np.minimum(shared * 8, width)
    inside = np.flatnonzero(common < width)
    inside = inside[inside > 0]
    a, b = order[inside - 1], order[inside]
    at = common[inside].astype(np.int64)
    tail_a, tail_b = (np.stack([padded[r, np.minimum(at + j, width - 1)] for j in range(8)], axis=1) for r in (a, b))
    differs = tail_a != tail_b
    common[inside] = at + np.where(differs.any(1), differs.argmax(1), 8)
    common[1:] = np.minimum(common[1:], np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    common[0] = 0
    return order, common


def repeated_reach(lefts: list[bytes], rights: list[bytes], copies, length: int = LENGTH, lead: int = LEAD):
    """For different surroundings of anchors: how far left of the anchor the outermost repeated window begins and how far
    right it ends (-1, -1 if there is none).

    A window that begins o bytes left is repeated if two surroundings agree in o bytes to the left and length - o to
    the right: neighbours in the sorted right sides that share so much form runs, so do the sorted left sides, and a
    pair of runs that holds two rows is a repeat. All windows hold the anchor, so their union is one interval.
    """
    import numpy as np

    n, most = len(rights), length - lead
    right_n, left_n = (np.array([len(x) for x in side], dtype=np.int64) for side in (rights, lefts))
    pad_r, pad_l = -(-length // 8) * 8, -(-most // 8) * 8
    right = np.frombuffer(b"".join(x.ljust(pad_r, b"\0") for x in rights), dtype=np.uint8).reshape(n, pad_r)
    left = np.frombuffer(b"".join(x[::-1].ljust(pad_l, b"\0") for x in lefts), dtype=np.uint8).reshape(n, pad_l)
    r_order, r_common = _sorted_common(right, right_n)
    l_order, l_common = _sorted_common(left, left_n)
    nearest, farthest = np.full(n, -1), np.full(n, -1)
    many = copies > 1
    nearest[many], farthest[many] = np.maximum(0, length - right_n[many]), np.minimum(left_n[many], most)
    impossible = many & (nearest > farthest)
    nearest[impossible] = farthest[impossible] = -1
    r_run, l_run = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for o in range(most + 1):
        r_run[r_order] = np.cumsum(r_common < length - o)
        l_run[l_order] = np.cumsum(l_common < o) if o else 0
        fit = np.flatnonzero((right_n >= length - o) & (left_n >= o))
        key = r_run[fit] * (n + 1) + l_run[fit]
        by = np.argsort(key, kind="stable")
        twin = np.zeros(len(fit), dtype=bool)
        equal = key[by][1:] == key[by][:-1]
        twin[by[1:][equal]] = twin[by[:-1][equal]] = True
        rows = fit[twin]
        farthest[rows] = np.maximum(farthest[rows], o)
        rows = rows[nearest[rows] < 0]
        nearest[rows] = o
    return farthest, np.where(nearest >= 0, length - nearest, -1)


def _counted_reach(every: DataFrame, length: int, lead: int) -> DataFrame:
    """key, back, ahead as of repeated_reach, for surroundings(key, left, right, n) of leads that are too common to be sorted in
    one task.

    A window that begins o bytes left is repeated if its hash (128 bits) occurs twice. The windows of STEP offsets in a row
    share all but STEP - 1 of their bytes: only where that core occurs twice are they hashed one by one. Hashes are counted
    with partial sums, so no task meets a lead's surroundings, however many there are.
    """
    most = length - lead
    rows = every.groupBy("key").agg(F.first("left").alias("left"), F.first("right").alias("right"), F.sum("n").alias("n"))
    rows = materialize(rows, "hot-surroundings")

    def cores(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            key, n, k, h = [], [], [], []
            for own, left, right, times in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for low in range(0, most + 1, STEP):
                    top = min(low + STEP - 1, most)
                    if max(low, length - len(right)) <= min(top, len(left)):
                        key.append(own)
                        n.append(times)
                        k.append(low)
                        h.append(xxhash.xxh3_64_intdigest(left[len(left) - low :] + right[: length - top], seed=low) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(k, pa.int32()), pa.array(h, pa.int64())], names=["key", "n", "k", "h"])

    def windows(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            key, n, o, w = [], [], [], []
            for own, left, right, times, lows in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for low in lows:
                    for offset in range(max(low, length - len(right)), min(low + STEP - 1, most, len(left)) + 1):
                        key.append(own)
                        n.append(times)
                        o.append(offset)
                        w.append(xxhash.xxh3_128_digest(left[len(left) - offset :] + right[: length - offset], seed=offset))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(o, pa.int64()), pa.array(w, pa.binary())], names=["key", "n", "o", "w"])

    core = rows.select("key", "left", "right", "n").mapInArrow(cores, "key binary, n long, k int, h long")
    core = materialize(core, "hot-cores")
    twice = core.groupBy("k", "h").agg(F.sum("n").alias("t")).filter("t > 1").select("k", "h")
    asked = core.join(twice, ["k", "h"], "left_semi").groupBy("key").agg(F.collect_list("k").alias("ks"))  # most / STEP at most
    one = materialize(rows.join(asked, "key").select("key", "left", "right", "n", "ks").mapInArrow(windows, "key binary, n long, o long, w binary"), "hot-windows")
    discard(core, rows)
    repeated = one.groupBy("w").agg(F.sum("n").alias("t")).filter("t > 1").select("w")
    return one.join(repeated, "w", "left_semi").groupBy("key").agg(F.max("o").alias("back"), (F.lit(length) - F.min("o")).alias("ahead"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """__doc, __text_hash, __spans: the sorted byte ranges covered by repeated strings, for documents that have any.

    Three passes: leads that occur twice are counted; the surroundings of such anchors (length bytes to the right and
    length - lead to the left) are cut out, equal ones of a task twice at most, and dealt by sampled range splitters
    over their leading bytes; each bucket merges equal ones, sorts and compares. Equal leads are never parted, and suffixes across a border
    differ within the leading bytes, so borders hide no match. Leads that occur more than HOT_LEAD times go by
    _counted_reach instead.
    """
    spark = docs.sparkSession
    plain = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text_hash"), "text")

    def leads(batches):
        import pyarrow as pa

        for _, texts in _texts(batches):
            for _, _, h in anchors(texts, length, lead):
                yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])

    counted = plain.mapInArrow(leads, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    counted = materialize(counted, "leads")
    sent = spark.sparkContext.broadcast(filter_bits(counted, "h"))
    hot_sent = spark.sparkContext.broadcast(filter_bits(counted.filter(F.col("n") > HOT_LEAD), "h"))
    discard(counted)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def surroundings(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        seen: dict[bytes, int] = {}
        for part, texts in _texts(batches):
            if len(seen) > SEEN:
                seen.clear()
            for rows, places, h in anchors(texts, length, lead):
                hit = in_filter(sent.value, h)
                if not len(hit):
                    continue
                # in a text of one letter every place is an anchor; equal ones in a row are sent as a range
                sent_rows, first, last, key, left, right, hot = [], [], [], [], [], [], []
                often = np.zeros(len(h), dtype=bool)
                often[in_filter(hot_sent.value, h)] = True
                for r, p, many in zip(rows[hit].tolist(), places[hit].tolist(), often[hit].tolist(), strict=True):
                    before, after = texts[r][max(0, p - length + lead) : p], texts[r][p : p + length]
                    k = xxhash.xxh3_128_digest(before + b"|%d|" % len(before) + after)
                    times = seen[k] = seen.get(k, 0) + 1
                    if key and key[-1] == k and sent_rows[-1] == r and last[-1] == p - 1:
                        last[-1] = p
                        continue
                    sent_rows.append(r)
                    first.append(p)
                    last.append(p)
                    key.append(k)
                    left.append(before if times <= 2 else None)  # twice tells all
                    right.append(after if times <= 2 else None)
                    hot.append(many)
                take = pa.array(sent_rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(key, pa.binary()), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(hot, pa.bool_())],
                    names=["__doc", "__text_hash", "place", "upto", "key", "left", "right", "hot"],
                )

    cut = materialize(plain.mapInArrow(surroundings, f"__doc {id_type}, __text_hash long, place long, upto long, key binary, left binary, right binary, hot boolean"), "surroundings")
    every = cut.filter("right is not null").select("key", "left", "right", (F.col("upto") - F.col("place") + 1).alias("n"), "hot")
    different = every.filter("not hot").drop("hot")
    buckets = max(1, -(-different.count() // BUCKET_ROWS))
    leading = F.substring("right", 1, lead)
    dealt = different.repartitionByRange(buckets, leading).sortWithinPartitions(leading, "key")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def result(held):
            far, end = repeated_reach([x[1] for x in held], [x[2] for x in held], np.array([x[3] for x in held]), length, lead)
            some = np.flatnonzero(far >= 0)
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in some], pa.binary()), pa.array(far[some]), pa.array(end[some])], names=["key", "back", "ahead"])

        held, last = [], None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "left", "right", "n")]
            for key, left, right, n in zip(*columns, strict=True):
                if held and key == held[-1][0]:
                    held[-1][3] += n
                    continue
                if right[:lead] != last and len(held) >= BUCKET_ROWS:
                    yield result(held)
                    held = []
                held.append([key, left, right, n])
                last = right[:lead]
        if held:
            yield result(held)

    reach = dealt.mapInArrow(compare, "key binary, back long, ahead long").unionByName(_counted_reach(every.filter("hot"), length, lead))
    spans = cut.select("__doc", "__text_hash", "place", "upto", "key").join(reach, "key").select("__doc", "__text_hash", F.struct((F.col("place") - F.col("back")).alias("a"), (F.col("upto") + F.col("ahead")).alias("b")).alias("s"))
    return spans.groupBy("__doc", "__text_hash").agg(F.sort_array(F.collect_set("s")).alias("__spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """A row for each document: doc_id, kept (the remaining bytes), text (kept as a string, torn characters as
    U+FFFD), n_bytes, n_removed, n_spans, kept_sha256.

    Spans that overlap or touch are one.

    Every byte covered by a string of `length` bytes that also starts anywhere else goes, strings judged on the input;
    matches don't cross documents. docs needs doc_id and text (null: empty). Rows that repeat an id are documents of
    their own; equal ones repeat each other. Other columns are ignored.
    """
    spans = materialize(repeated_spans(docs, length, lead), "repeated-spans")
    plain = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text_hash"), "text")
    joined = plain.join(spans.hint("merge"), plain["doc_id"].eqNullSafe(spans["__doc"]) & (plain["__text_hash"] == spans["__text_hash"]), "left")
    joined = joined.select("doc_id", "text", F.transform("__spans", lambda s: s["a"]).alias("a"), F.transform("__spans", lambda s: s["b"]).alias("b"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = {"kept": [], "text": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for text, starts, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = (text or "").encode()
                parts, at, runs, end = [], 0, 0, -1
                for a, b in zip(starts or [], ends or [], strict=True):
                    runs += a > end
                    parts.append(data[at : max(at, a)])
                    at = end = max(at, b)
                parts.append(data[at:])
                kept = b"".join(parts)
                for name, x in zip(out, (kept, kept.decode(errors="replace"), len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()), strict=True):
                    out[name].append(x)
            types = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=["doc_id", *out])

    return joined.mapInArrow(run, f"doc_id {id_type}, kept binary, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns and, behind them, the remaining text."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")
