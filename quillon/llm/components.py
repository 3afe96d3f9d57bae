"""Connected components of an edge table, and a filter of fixed size for broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.storage import discard, materialize

FILTER_BITS = 1 << 25


#: Edges up to so many (32 MB) are solved by one task in memory; more by rounds over all executors.
LOCAL_EDGES = 1 << 21


def _solved(a, b):
    """Nodes and their smallest reachable nodes, by hooking roots to smaller ones and jumping along the way."""
    import numpy as np

    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        now = label.copy()
        for end in (u, v, label[u], label[v]):
            np.minimum.at(now, end, low)
        while (far := now[now] < now).any():
            now[far] = now[now][far]
        if (now == label).all():
            return nodes, nodes[label]
        label = now


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges(a, b), longs.

    A set of edges of proven small size is solved in one task. Others go by alternating large-star and small-star steps;
    each step's edges are written to the shared folder, and the driver sees two numbers a round. The result may be
    discarded like a table.
    """
    if edges.count() <= LOCAL_EDGES:

        def solve(batches):
            import numpy as np
            import pyarrow as pa

            held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
            if held:
                nodes, least = _solved(*(np.concatenate(x) for x in zip(*held, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])

        return materialize(edges.select("a", "b").filter("a <> b").coalesce(1).mapInArrow(solve, "node long, component long"), "components")
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w")
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, F.col("u") == F.col("w"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        before, now = now, materialize(small, "stars")
        discard(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if state == seen:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            out._table_path = now._table_path
            return out
        seen = state


def filter_bits(values: DataFrame, column: str) -> bytes:
    """A bit for each value modulo FILTER_BITS: 4 MB whatever the number of values, put together by words in Spark."""
    import numpy as np

    bit = F.pmod(F.col(column), F.lit(FILTER_BITS))
    words = values.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(`{column}`, 64) as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    marks = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    marks[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return marks.tobytes()


def in_filter(marks: bytes, values):
    """Places of the values whose bit is set."""
    import numpy as np

    words, spot = np.frombuffer(marks, dtype=np.uint64), np.mod(values, FILTER_BITS)
    return np.flatnonzero((words[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1))
