"""Similarity join on word shingles: parity sketches, pigeonhole by size band, verification on words, components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.components import components, filter_bits, in_filter
from quillon.llm.rolling import mix
from quillon.llm.storage import discard, materialize, table, unused

WORDS = 5
#: Two sets link when 100 * intersection >= 75 * union, that is, when 7 * symmetric difference <= sum of sizes.
#: Entries that one bucket of sketch cells holds about; the number of buckets grows with the texts.
BUCKET_ENTRIES = 3_000_000
FLUSH_ENTRIES = 1_000_000
#: A cell that so many sets of one flush share passes as rows of its own and not through its bucket's memory.
HOT_CELL = 1_000
#: Lists of at most so many open entries are compared in one go, longer ones round so many hubs at a time.
SMALL_LIST, HUBS = 64, 64
_BATCH = 1 << 21
_C = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def bounds() -> list[int]:
    """Band s holds the sizes from bounds[s] to bounds[s + 1] - 1. The bands are wide enough that linked sets, whose
    sizes differ by a third at most, are in the same or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, math.ceil((16 / 9) ** len(out) - 1e-9)))
    return out


def cells_of(top: int) -> int:
    """Cells of the sketch for sets of at most `top` shingles: about two shingles a cell, fewer in small sets."""
    return math.ceil(0.5 * top + 4 * math.sqrt(top))


def farthest(size: int, top: int) -> int:
    """The largest symmetric difference of a set of `size` with a linked one of at most `top`: (size + other) / 7, as
    linked sets share 3/7 of their sizes' sum and the other is at most 4/3 as large."""
    return (size + min(4 * size // 3, top)) // 7


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; bytes.split() parts at just the six characters of the contract."""
    return text.lower().split()


def shingle_set(words: list[bytes]):
    """The sorted different hashes of a text's 5-word shingles; of all its words if there are fewer."""
    import numpy as np
    import xxhash

    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(h) >= WORDS:
        n = len(h) - WORDS + 1
        total = h[:n] * np.uint64(_C[0])
        for k in range(1, WORDS):
            total += h[k : k + n] * np.uint64(_C[k])
        return np.unique(mix(total))
    if len(h):
        total = sum((int(w) * _C[k] for k, w in enumerate(h)), len(h) * _C[5]) & (1 << 64) - 1
        return mix(np.array([total], dtype=np.uint64))
    return h


def set_key(hashes) -> tuple[int, int]:
    """Two signed 64-bit names of a set of shingles. The first names it in lists and links, both name equal sets."""
    import numpy as np

    with np.errstate(over="ignore"):
        sums = [np.sum(mix(hashes * np.uint64(c))) + np.uint64(len(hashes)) * np.uint64(_C[2]) for c in (_C[1], _C[4])]
    return tuple(int(x) for x in mix(np.array(sums, dtype=np.uint64)).astype(np.int64))


def sketch_cells(hashes, slot: int, top: int):
    """The non-empty cells of the parity sketch of a set in a slot, as one number each, and how many of them a linked
    set shares at least.

    Shingles go to cells by their hash; a cell is the XOR of its shingles, so it changes only if it holds shingles of the
    symmetric difference. That difference is at most farthest(), so of more non-empty cells some are the same in the
    other set. In the rare set that hasn't so many, empty cells count too: then there are more cells than differences.
    """
    import numpy as np

    cells = cells_of(top)
    at = ((hashes >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    value = np.bitwise_xor.reduceat(mix(hashes + np.uint64(_C[3])), begin)
    where = at[begin]
    need = len(where) - farthest(len(hashes), top)
    if need < 1:
        empty = np.setdiff1d(np.arange(cells, dtype=np.uint64), where)
        where, value, need = np.concatenate([where, empty]), np.concatenate([value, np.zeros(len(empty), dtype=np.uint64)]), 1
    return mix(value + where * np.uint64(_C[4]) + np.uint64(slot * _C[5] & (1 << 64) - 1)), need


def bit_sketch(hashes) -> bytes:
    """Parity bits: each shingle flips one of 4 to 8 bits a shingle (a power of two, 64 at least)."""
    import numpy as np

    width = max(64, 1 << (4 * max(len(hashes), 1) - 1).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """The differing bits of two sketches, the wider one folded by XOR to the other's width: at most the symmetric
    difference of the sets, as a shingle in both flips the same bit of both."""
    import numpy as np

    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _texts(batches, column: int):
    """Slices of the record batches with texts of about _BATCH bytes in all, and those texts as bytes."""
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(column).to_pylist()]
        low = size = 0
        for i, t in enumerate(texts):
            if size + len(t) > _BATCH and i > low:
                yield batch.slice(low, i - low), texts[low:i]
                low, size = i, 0
            size += len(t)
        if texts:
            yield batch.slice(low), texts[low:]


_LOW = (1 << 40) - 1


def _packed(cells, hot, index, keys, slots) -> bytes:
    """Sorted 40-bit cells, those of them that are hot, the place of each cell's set, and the sets' keys and slots."""
    import numpy as np
    import zstandard

    order = np.argsort(cells)
    cells, index = cells[order], index[order]
    used, place = np.unique(index, return_inverse=True)
    planes = [((cells >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8).tobytes() for i in range(4, -1, -1)]
    body = [np.array([len(cells), len(used), len(hot)], dtype=np.int64).tobytes(), hot.astype(np.uint64).tobytes(), keys[used].tobytes(), *planes, place.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), slots[used].astype(np.uint8).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def _unpacked(blob: bytes):
    import numpy as np
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(blob)
    n, used, some = np.frombuffer(body, dtype=np.int64, count=3)
    hot = np.frombuffer(body, dtype=np.uint64, offset=24, count=some)
    keys = np.frombuffer(body, dtype=np.int64, offset=24 + 8 * some, count=used)
    raw = np.frombuffer(body, dtype=np.uint8, offset=24 + 8 * (some + used))
    cells = np.zeros(n, dtype=np.uint64)
    for i in range(5):
        cells = (cells << np.uint64(8)) | raw[i * n : (i + 1) * n]
    place = np.ascontiguousarray(raw[5 * n : 9 * n].reshape(4, n).T).view(np.uint32).ravel()
    return cells, hot, place, keys, raw[9 * n : 9 * n + used]


_NAMES = ["bucket", "doc_id", "text_hash", "key", "key2", "n", "slots", "needs", "cells", "list", "slot", "members"]


def _sketched(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of three kinds: a document with the names and size of its set and what its slots need; a bucket's packed
    cells of the sets that a task has met; the sets of a task that share a hot cell."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        edges, seen, row = bounds(), set(), 0
        cells, index, keys, slots, held = [], [], [], [], 0
        types = [pa.int32(), None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64())]

        def out(size, **columns):
            made = [columns.get(c, pa.nulls(size, t)) for c, t in zip(_NAMES, types, strict=True)]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)], names=_NAMES)

        def flush():
            every, of = np.concatenate(cells), np.repeat(np.arange(len(index)), index)
            key, slot = np.array(keys, dtype=np.int64), np.array(slots)
            bucket = (every >> np.uint64(40)) % np.uint64(buckets)
            order = np.lexsort((every & np.uint64(_LOW), bucket))
            every, of, bucket = every[order] & np.uint64(_LOW), of[order], bucket[order]
            begin = np.flatnonzero(np.concatenate([[True], (every[1:] != every[:-1]) | (bucket[1:] != bucket[:-1])]))
            many = np.diff(np.append(begin, len(every)))
            hot = np.flatnonzero(many >= HOT_CELL)
            left_out = np.zeros(len(every), dtype=bool)
            for i in hot.tolist():
                a, b = begin[i], begin[i] + many[i]
                left_out[a:b] = True
                yield out(1, bucket=[int(i) % buckets], list=[int(every[a]) | int(bucket[a]) << 40], slot=[int(slot[of[a]])], members=[np.unique(key[of[a:b]])])
            hot_cells, hot_bucket = every[begin[hot]], bucket[begin[hot]]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                own = np.flatnonzero(~left_out[cut[b] : cut[b + 1]]) + cut[b]
                marked = hot_cells[hot_bucket == b] if len(hot) else hot_cells
                if len(own) or len(marked):
                    yield out(1, bucket=[b], cells=[_packed(every[own], marked, of[own], key, slot)])

        for part, texts in _texts(batches, 2):
            types[1] = part.schema.field(0).type
            rows = [[], [], [], [], []]
            for text in texts:
                hashes = shingle_set(words_of(text))
                name, n = set_key(hashes), len(hashes)
                own_slots, needs = [], []
                if n:
                    band = int(np.searchsorted(edges, n, side="right")) - 1
                    for slot in [band, *[band + 1] * (4 * n // 3 >= edges[band + 1])]:
                        got, need = sketch_cells(hashes, slot, edges[slot + 1] - 1)
                        own_slots.append(slot)
                        needs.append(need)
                        if name not in seen:
                            cells.append(got)
                            index.append(len(got))
                            keys.append(name[0])
                            slots.append(slot)
                            held += len(got)
                    seen.add(name)
                for to, x in zip(rows, (*name, n, own_slots, needs), strict=True):
                    to.append(x)
                if held >= FLUSH_ENTRIES:
                    yield from flush()
                    cells, index, keys, slots, held = [], [], [], [], 0
                    seen.clear()
            spread = (row + np.arange(len(texts))) % buckets  # any bucket will do for a document's row
            row += len(texts)
            yield out(len(texts), bucket=spread.astype(np.int32), doc_id=part.column(0), text_hash=part.column(1), key=rows[0], key2=rows[1], n=rows[2], slots=rows[3], needs=rows[4])
        if held:
            yield from flush()

    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text").mapInArrow(
        run, f"bucket int, doc_id {id_type}, text_hash long, key long, key2 long, n long, slots array<int>, needs array<int>, cells binary, list long, slot int, members array<long>"
    )


def _matched(sketched: DataFrame, id_type: str) -> DataFrame:
    """Documents as they are, and a row for each set of a list of sets that share cells: list, slot, how many cells,
    key. A bucket's memory holds the cells that few share; a hot one's sets are in rows of their own already."""

    def run(bucket):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        docs = bucket.filter(pc.is_valid(bucket["n"]))
        parts = [_unpacked(b) for b in bucket["cells"].to_pylist() if b is not None]
        made = [[], [], [], []]  # list, slot, times, key

        def add(name, slot, times, keys):
            for to, x in zip(made, (name, slot, times), strict=False):
                to.append(np.full(len(keys), x, dtype=np.int64))
            made[3].append(np.asarray(keys, dtype=np.int64))

        rare = bucket.filter(pc.is_valid(bucket["members"])).select(["list", "slot", "members"]).to_pylist()
        for x in rare:
            add(x["list"], x["slot"], 1, x["members"])
        if parts:
            named = np.concatenate([np.rec.fromarrays([k, s], dtype=[("k", "i8"), ("s", "u1")]) for *_, k, s in parts])
            ids, to = np.unique(named, return_inverse=True)
            begin = np.cumsum([0, *(len(p[3]) for p in parts)])
            cells = np.concatenate([p[0] for p in parts])
            hot = np.unique(np.concatenate([p[1] for p in parts]))
            owner = np.concatenate([to[b + p[2].astype(np.int64)] for b, p in zip(begin, parts, strict=False)])
            order = np.argsort(cells, kind="stable")
            cells = cells[order]
            twin = np.zeros(len(cells) + 1, dtype=bool)
            twin[1:-1] = cells[1:] == cells[:-1]
            some = np.flatnonzero(twin[1:] | twin[:-1] | np.isin(cells, hot))
            cells, owner = cells[some], owner[order[some]]
            again = np.lexsort((owner, cells))
            cells, owner = cells[again], owner[again]
            fresh = np.ones(len(cells), dtype=bool)
            fresh[1:] = (cells[1:] != cells[:-1]) | (owner[1:] != owner[:-1])
            cells, owner = cells[fresh], owner[fresh]
            cut = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]])) if len(cells) else np.zeros(1, dtype=int)
            of_hot, number = set(hot.tolist()), int(bucket["bucket"][0].as_py())
            lists: dict[bytes, int] = {}
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if int(cells[a]) in of_hot:
                    add(int(cells[a]) | number << 40, int(ids["s"][owner[a]]), 1, ids["k"][owner[a:b]])
                elif b - a > 1:
                    m = owner[a:b].tobytes()
                    lists[m] = lists.get(m, 0) + 1
            for m, times in lists.items():
                own = np.frombuffer(m, dtype=np.int64)
                keys, slot = ids["k"][own], int(ids["s"][own[0]])
                add(xxhash.xxh3_64_intdigest(keys.tobytes(), seed=slot) - (1 << 63), slot, times, keys)
        lists_of = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in made]
        n, k = docs.num_rows, len(lists_of[0])
        columns = [pa.concat_arrays([*docs[c].chunks, pa.nulls(k, docs.schema.field(c).type)]) for c in ("doc_id", "text_hash")]
        key = pa.concat_arrays([*docs["key"].chunks, pa.array(lists_of[3])])
        columns += [key, *(pa.concat_arrays([*docs[c].chunks, pa.nulls(k, docs.schema.field(c).type)]) for c in ("key2", "n", "slots", "needs"))]
        columns += [pa.concat_arrays([pa.nulls(n, t), pa.array(x, t)]) for x, t in zip(lists_of, (pa.int64(), pa.int32(), pa.int32()), strict=False)]
        return pa.Table.from_arrays(columns, names=["doc_id", "text_hash", "key", "key2", "n", "slots", "needs", "list", "slot", "times"])

    return sketched.groupBy("bucket").applyInArrow(run, f"doc_id {id_type}, text_hash long, key long, key2 long, n long, slots array<int>, needs array<int>, list long, slot int, times int")


def _held(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, n, bits (its sketch), words (lower-cased, one space between) of the wanted(key, h): a filter of fixed size
    passes the documents to read again, h being the hash of a doc_id."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_bits(wanted, "h"))

    def run(batches):
        import pyarrow as pa

        def chosen():
            for batch in batches:
                hit = in_filter(sent.value, batch.column(0).to_numpy())
                if len(hit):
                    yield batch.take(pa.array(hit))

        for _, texts in _texts(chosen(), 1):
            split = [w for w in map(words_of, texts) if w]
            sets = [shingle_set(w) for w in split]
            columns = [pa.array([set_key(s)[0] for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bit_sketch(s) for s in sets], pa.binary()), pa.array([b" ".join(w) for w in split], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "bits", "words"])

    found = docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, "key long, n long, bits binary, words binary")
    keys = wanted.select(F.col("key").alias("__k")).distinct()
    return materialize(found.join(keys, F.col("key") == F.col("__k"), "left_semi").dropDuplicates(["key"]), "shingle-texts")


def _shingles(words: bytes) -> set[tuple[bytes, ...]]:
    w = words.split(b" ")
    return set(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)) if len(w) >= WORDS else {tuple(w)}


def linked(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sets link: first by the Hamming distance of their sketches, then by their words."""

    def near(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 6)]
            hit = [i for i, (na, x, nb, y) in enumerate(zip(*columns, strict=True)) if 7 * hamming(x, y) <= na + nb]
            yield batch.select(["a", "b"]).take(pa.array(hit, pa.int64()))

    def exact(batches):
        import pyarrow as pa

        last, hub = None, set()
        for batch in batches:
            hit = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if y != last:
                    last, hub = y, _shingles(y)
                own = _shingles(x)
                shared = len(own & hub)
                if 100 * shared >= 75 * (len(own) + len(hub) - shared):
                    hit.append(i)
            yield batch.select(["a", "b"]).take(pa.array(hit, pa.int64()))

    def side(of: str, *columns: str) -> DataFrame:
        return held.select(F.col("key").alias(of), *[F.col(c).alias(f"{c}_{of}") for c in columns])

    sketched = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b").filter("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    close = sketched.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(near, "a long, b long")
    both = close.join(side("a", "words"), "a").join(side("b", "words"), "b").select("a", "b", "words_a", "words_b")
    return both.mapInArrow(exact, "a long, b long")


def _open(rows: DataFrame, label: DataFrame) -> DataFrame:
    """key, component of the sets that may link to another component: such a set shares with sets of other components,
    in lists of several components, as many cells as it needs for a link at all."""
    placed = rows.join(label, "key", "left").withColumn("component", F.coalesce("component", "key"))
    several = placed.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("list")
    apart = placed.join(several, "list", "left_semi").groupBy("slot", "key").agg(F.sum("times").alias("t"), F.first("need").alias("need"), F.first("component").alias("component"))
    return materialize(apart.filter("t >= need").groupBy("key").agg(F.first("component").alias("component")), "open-sets")


def _prefixes(open_sets: DataFrame, held: DataFrame) -> DataFrame:
    """shingle, key, n, component, pos: what of the open sets' shingles can be the first one that two linked sets of
    different components share.

    Shingles are in one order for all sets: those that only one component has, then the others, rare ones first. Linked
    sets share 3/7 of their sizes' sum, 3/4 of the larger set, so the first shared shingle stands in the first quarter.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(w.split(b" ")) for w in part.column(3).to_pylist()]
                take = pa.array([i for i, s in enumerate(sets) for _ in range(len(s))], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).astype(np.int64)), *(part.column(i).take(take) for i in range(3))], names=["shingle", "key", "n", "component"])

    texts = open_sets.join(held.select("key", "n", "words"), "key").select("key", "n", "component", "words")
    every = materialize(texts.mapInArrow(run, "shingle long, key long, n long, component long"), "open-shingles")
    shared = every.groupBy("shingle").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("shingle", "df")
    own = Window.partitionBy("key")
    crossing = every.join(shared, "shingle").withColumns({"crossing": F.count("*").over(own), "place": F.row_number().over(own.orderBy("df", "shingle"))})
    ranked = crossing.filter("4 * crossing >= 3 * n").withColumn("pos", F.expr("n - crossing + place - 1")).filter("4 * pos <= n")
    out = materialize(ranked.select("shingle", "key", "n", "component", "pos"), "open-prefixes")
    discard(every)
    return out


#: Two entries of a list may be the first shingle that linked sets of different components share.
_FITS = "{a}.component <> {b}.component and 7 * ({a}.n - {a}.pos) >= 3 * ({a}.n + {b}.n) and 7 * ({b}.n - {b}.pos) >= 3 * ({a}.n + {b}.n)"


def _pruned(entries: DataFrame) -> DataFrame:
    """Entries for which some other component's entry of the same list may fit, by that list's least size and reach; with the
    number of entries of their list (size) and of their component in it (own)."""
    per = entries.groupBy("shingle", "component").agg(F.min("n").alias("least"), F.max(F.expr("4 * n - 7 * pos")).alias("reach"), F.count("*").alias("own"))
    small, far = F.struct("least", "component"), F.struct("reach", "component")
    ends = per.groupBy("shingle").agg(F.min(small).alias("small"), F.max(far).alias("far"), F.count("*").alias("k"), F.sum("own").alias("size")).filter("k > 1").drop("k")
    both = per.join(ends, "shingle")
    rest = both.groupBy("shingle").agg(F.min(F.when(F.col("component") != F.col("small.component"), F.col("least"))).alias("small2"), F.max(F.when(F.col("component") != F.col("far.component"), F.col("reach"))).alias("far2"))
    known = both.join(rest, "shingle").select("shingle", "component", "own", "size", F.when(F.col("small.component") == F.col("component"), F.col("small2")).otherwise(F.col("small.least")).alias("small"), F.when(F.col("far.component") == F.col("component"), F.col("far2")).otherwise(F.col("far.reach")).alias("far"))
    return entries.join(known, ["shingle", "component"]).filter("3 * small <= 4 * n - 7 * pos and 3 * n <= far").select(*_ENTRY, "own", "size")


_ENTRY = ["shingle", "key", "n", "component", "pos"]


def _round(fit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to compare now, and the entries that aren't done with it.

    A list of at most SMALL_LIST entries is compared whole. Of a longer one HUBS entries are compared with all, those of
    components with few entries first; they are done then. So an entry makes at most SMALL_LIST or HUBS pairs a round.
    """
    small, large = fit.filter(F.col("size") <= SMALL_LIST), fit.filter(F.col("size") > SMALL_LIST)
    pairs = small.alias("x").join(small.alias("y"), F.expr("x.shingle = y.shingle and x.key < y.key and " + _FITS.format(a="x", b="y"))).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    hubs = large.groupBy("shingle", F.pmod(F.xxhash64("key"), F.lit(HUBS)).alias("part")).agg(F.min(F.struct("own", "key", "n", "component", "pos")).alias("hub")).select("shingle", "hub.*")
    pairs = pairs.unionByName(large.alias("x").join(hubs.alias("y"), F.expr("x.shingle = y.shingle and x.key <> y.key and " + _FITS.format(a="x", b="y"))).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")))
    left = large.select(*_ENTRY).join(hubs.select("shingle", "key"), ["shingle", "key"], "left_anti")
    return materialize(pairs.distinct(), "pairs"), materialize(left, "open-left")


def _links(docs: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame | None:
    """node, component of the sets that link, found without emitting all pairs of a list.

    First each list's hub, the set that shares most of all, is compared with the others, which joins copies of one original. What is then in one component
    needs no more pairs. Sets that may link across components are compared where their first shared shingles meet.
    """
    held = _held(docs, asked.select("key", "h"))
    pairs = materialize(rows.filter("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    links = materialize(linked(pairs, held), "links")
    discard(pairs)
    label = components(links)
    open_sets = _open(rows, label.withColumnRenamed("node", "key"))
    if not open_sets.isEmpty():
        entries = _prefixes(open_sets, held)
        while True:
            fit = materialize(_pruned(entries), "open-entries")
            discard(entries)
            if fit.isEmpty():
                discard(fit)
                break
            pairs, left = _round(fit)
            discard(fit)
            more = materialize(linked(pairs, held).unionByName(links), "links")
            discard(pairs, links, label)
            links = more
            label = components(links)
            now = label.select(F.col("node").alias("key"), F.col("component").alias("now"))
            entries = materialize(left.join(now, "key", "left").withColumn("component", F.coalesce("now", "component")).drop("now"), "open-prefixes")
            discard(left)
    discard(open_sets, held, links)
    return label


def classes(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, text_hash, n (shingles), least (struct no_id, doc_id, text_hash: the first of its
    component, rows without an id last; of rows without words the row itself)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    chars = docs.select(F.sum(F.length("text")).alias("n")).collect()[0]["n"] or 0
    buckets = max(16, math.ceil(chars / 6 / BUCKET_ENTRIES))
    matched = materialize(_matched(_sketched(docs, buckets), id_type), "shingle-matches")
    known = materialize(matched.filter("n is not null").select("doc_id", "text_hash", "key", "key2", "n"), "shingle-names")
    needs = matched.filter("n > 0").groupBy("key").agg(F.first("slots").alias("slots"), F.first("needs").alias("needs"), F.min("doc_id").alias("doc_id"))
    needs = needs.select("key", F.xxhash64("doc_id").alias("h"), F.explode(F.arrays_zip("slots", "needs")).alias("z")).select("key", "h", F.col("z.slots").alias("slot"), F.col("z.needs").alias("need"))
    lists = matched.filter("list is not null").select("list", "slot", "times", "key")
    shared = lists.groupBy("slot", "key").agg(F.sum("times").alias("shared"))
    asked = materialize(shared.join(needs, ["slot", "key"]).filter("shared >= need"), "shingle-candidates")
    fit = lists.join(asked.select("slot", "key", "need", "shared"), ["slot", "key"])
    hubs = fit.groupBy("list").agg(F.max(F.struct("shared", "key")).alias("hub"), F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi").select("list", F.col("hub.key").alias("hub"))
    rows = materialize(fit.select("list", "slot", "times", "key", "need").join(hubs, "list"), "shingle-lists")
    discard(matched)
    label = _links(docs, rows, asked)
    discard(rows, asked)
    named = known.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("one", F.coalesce("component", "key")).withColumn("two", F.when(F.col("component").isNull(), F.col("key2")).otherwise(0))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))
    first = named.filter("n > 0").groupBy("one", "two").agg(F.min(own).alias("first"), F.count("*").alias("k")).filter("k > 1").select(F.col("one").alias("of"), F.col("two").alias("of2"), "first")
    joined = named.join(first, (F.col("one") == F.col("of")) & (F.col("two") == F.col("of2")), "left")
    return joined.select("doc_id", "text_hash", "n", F.when((F.col("n") > 0) & F.col("first").isNotNull(), F.col("first")).otherwise(own).alias("least"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included).

    docs needs doc_id and text; other columns are ignored. Words are runs of anything but white space, A-Z lower-cased;
    a text of fewer than five is one shingle; one without words, or null, links with nothing. Rows with equal sets are
    linked (rows that repeat an id too); a null doc_id is never the smallest one unless all are null.

    Equal sets are one class from the start (by a name of 128 bits). A set joins the slot of its size band, and the next
    band's if a linked set may be there. Sets that share sketch cells are candidates; one that shares fewer cells in all
    than any linked set would share with it is dropped. Candidates are compared with the hub of their lists, and only
    what may still join two components is compared further. Each link is accepted on the words themselves.
    """
    return classes(docs).select("doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One row of docs of each component: that with the smallest doc_id, rows without one last; all columns stay.

    Repeated rows are copies: one stays. Rows without words link with nothing and all stay.
    """
    of, text, gone, copies = (unused(docs, f"__{c}") for c in ("of", "text", "gone", "copies"))
    per = classes(docs).filter("n > 0").groupBy("doc_id", "text_hash").agg(F.first("least").alias("least"), F.count("*").alias(copies))
    other = ~(F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.text_hash") == F.col("text_hash")))
    fate = materialize(per.select(F.col("doc_id").alias(of), F.col("text_hash").alias(text), other.alias(gone), copies).filter(F.col(gone) | (F.col(copies) > 1)), "fates")
    same = docs["doc_id"].eqNullSafe(fate[of]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == fate[text])
    kept = docs.join(fate, same, "left_anti")
    repeated = fate.filter(~F.col(gone))
    if repeated.isEmpty():
        return kept
    first = F.row_number().over(Window.partitionBy(of, text).orderBy(F.lit(0)))
    once = docs.join(repeated, same).withColumn(gone, first).filter(F.col(gone) == 1)
    return kept.unionByName(once.select(*docs.columns))


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
