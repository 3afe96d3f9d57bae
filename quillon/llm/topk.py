"""Exact top-k by inner product: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz residual bounds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.storage import materialize, table

BLOCK_ROWS = 16_384
PACK_QUERIES = 4_096
HEAD_DIMS = 16
STEP = 1_024
#: Share of pairs left by the bounds from which all of a step are multiplied at once.
DENSE = 0.01
#: Parts in which the partitions' moments are summed.
FOLDS = 32


def valid_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """__uid, vec_id, v (floor(scale * x) as longs) and norm of the vectors that take part.

    Left out: vectors that are null or empty or hold null or non-finite components, rows without vec_id, and vectors of
    another number of components than most have (a product with them is not defined). Repeated rows take part each.
    """
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0) & ~F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(True))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    kept = vectors.filter(fine).select("vec_id", v.alias("v"))
    sizes = kept.groupBy(F.size("v").alias("__d")).count().orderBy(F.desc("count"), "__d").limit(1).collect()
    kept = kept.filter(F.size("v") == (sizes[0]["__d"] if sizes else 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    return kept.withColumn("norm", norm).withColumn("__uid", F.monotonically_increasing_id())


def rotation(vectors: DataFrame, dims: int):
    """The right singular vectors of all vectors, most energy first, from second moments summed by partition."""
    import numpy as np

    def moments(batches):
        import pandas as pd

        total = np.zeros((dims, dims))
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, dims))
            total += x.T @ x
        yield pd.DataFrame({"m": [total.ravel()]})

    def fold(batches):
        import pandas as pd

        total = np.zeros(dims * dims)
        for pdf in batches:
            for m in pdf["m"]:
                total += m
        yield pd.DataFrame({"m": [total]})

    rows = vectors.select("v").mapInPandas(moments, "m array<double>").repartition(FOLDS).mapInPandas(fold, "m array<double>").collect()
    total = sum((np.array(r["m"]) for r in rows), np.zeros(dims * dims)).reshape(dims, dims)
    values, columns = np.linalg.eigh(total)
    return columns[:, np.argsort(-values)]


def _rank_cells(k: int, rot, head: int):
    """The function for one pack of queries and one block of vectors: the pack's k best within the block."""

    def run(key, queries, block):
        import numpy as np
        import pandas as pd

        columns = ["__quid", "query_id", "vec_id", "score"]
        if not len(queries) or not len(block):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
        block = block.sort_values(["norm", "__uid"], ascending=[False, True])
        q, x = (np.stack(t["v"].to_numpy()).astype(np.int64) for t in (queries, block))
        qf, xf = q.astype(float) @ rot, x.astype(float) @ rot
        q_rest, x_rest = (np.sqrt((m[:, head:] ** 2).sum(1)) for m in (qf, xf))
        q_norm, x_norm = queries["norm"].to_numpy(), block["norm"].to_numpy()
        q_uid, x_uid, x_id = queries["__uid"].to_numpy(), block["__uid"].to_numpy(), block["vec_id"].to_numpy()
        floor = queries["__floor"].to_numpy().astype(float)
        small = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**52
        qd, xd = q.astype(float), x.astype(float)
        best_score = np.full((len(q), k), -np.inf)
        best_row = np.full((len(q), k), -1, dtype=np.int64)
        for low in range(0, len(x), STEP):
            own = slice(low, min(low + STEP, len(x)))
            need = np.maximum(best_score[:, -1], floor)
            slack = 1e-9 * q_norm * x_norm[low] + 1e-6
            open_ = np.flatnonzero(q_norm * x_norm[low] + slack >= need)  # longest vector of the rest
            if not len(open_):
                break
            part = qf[open_, :head] @ xf[own, :head].T
            part += np.outer(q_rest[open_], x_rest[own]) + slack[open_, None]
            alive = part >= need[open_, None]
            _, mine, its = np.intersect1d(q_uid[open_], x_uid[own], return_indices=True)
            alive[mine, its] = False
            share = np.count_nonzero(alive) / alive.size
            if not share:
                continue
            if small and share > DENSE:  # so many are left that one product of matrices is cheaper; exact, see `small`
                whole = qd[open_] @ xd[own].T
                whole[~alive] = -np.inf
                if whole.shape[1] > k:
                    need_here = np.maximum(need[open_], np.partition(whole, -k, axis=1)[:, -k])
                else:
                    need_here = need[open_]
                a, b = np.nonzero(alive & (whole >= need_here[:, None]))
                exact = whole[a, b]
                a, b = open_[a], b + low
            else:
                a, b = np.nonzero(alive)
                a, b = open_[a], b + low
                exact = np.empty(len(a))
                for s in range(0, len(a), 1 << 18):
                    t = slice(s, s + (1 << 18))
                    exact[t] = np.einsum("ij,ij->i", q[a[t]], x[b[t]])
            order = np.lexsort((x_id[b], -exact, a))
            a, b, exact = a[order], b[order], exact[order]
            first = np.searchsorted(a, a)
            near = np.arange(len(a)) - first < k
            a, b, exact, rank = a[near], b[near], exact[near], (np.arange(len(a)) - first)[near]
            rows = np.unique(a)
            score = np.concatenate([best_score[rows], np.full((len(rows), k), -np.inf)], axis=1)
            row = np.concatenate([best_row[rows], np.full((len(rows), k), -1)], axis=1)
            at = np.searchsorted(rows, a)
            score[at, k + rank], row[at, k + rank] = exact, b
            ids = np.where(row >= 0, x_id[row], np.iinfo(np.int64).max)
            keep = np.lexsort((ids, -score), axis=1)[:, :k]
            best_score[rows], best_row[rows] = np.take_along_axis(score, keep, 1), np.take_along_axis(row, keep, 1)
        a, b = np.nonzero(best_row >= 0)
        x_of = best_row[a, b]
        score = np.einsum("ij,ij->i", q[a], x[x_of])
        return pd.DataFrame({"__quid": q_uid[a], "query_id": queries["vec_id"].to_numpy()[a], "vec_id": x_id[x_of], "score": score})

    return run


def top_k(vectors: DataFrame, is_query=None, k: int = 20, scale: int = 64, block_rows: int = BLOCK_ROWS, pack_queries: int = PACK_QUERIES) -> DataFrame:
    """Each query's k best other vectors by integer inner product: query_id, rank (from 1), vec_id, score; ties to the
    smaller vec_id; all, if there are fewer than k. valid_vectors() says which vectors take part.

    Blocks are ranges of (norm descending, row), so equal norms don't pile up. Each pack of queries first meets the
    block of the longest vectors, whose k-th best score bounds its result from below; it then meets only the blocks
    whose longest vector could still reach that bound by Cauchy-Schwarz, and within a block rows go by the partial sum
    over the first rotated components plus the product of the remainders' lengths. What is left is counted exactly in
    integers. The driver holds one line a block and the rotation.
    """
    import numpy as np

    queries_are = (F.col("vec_id") % 20 == 0) if is_query is None else is_query
    valid = materialize(valid_vectors(vectors, scale), "vectors")
    n = valid.count()
    blocks = max(1, math.ceil(n / block_rows))
    ranged = valid.repartitionByRange(blocks, F.desc("norm"), "__uid").withColumn("__block", F.spark_partition_id())
    ranged = materialize(ranged, "vector-blocks")
    first_row = ranged.limit(1).collect()
    dims = len(first_row[0]["v"]) if first_row else 1
    heads = ranged.groupBy("__block").agg(F.max("norm").alias("norm")).orderBy(F.desc("norm"), "__block").collect()
    longest = np.array([r["norm"] for r in heads])
    order = {r["__block"]: i for i, r in enumerate(heads)}
    head = min(HEAD_DIMS, dims)
    rot = rotation(ranged, dims) if heads else np.eye(dims)
    n_queries = ranged.filter(queries_are).count()
    packs = max(1, math.ceil(n_queries / pack_queries))
    queries = ranged.filter(queries_are).withColumn("__pack", F.pmod(F.xxhash64("__uid"), F.lit(packs)).cast("int"))
    cells = "__quid long, query_id long, vec_id long, score long"
    run = _rank_cells(k, rot, head)
    top = min(order, key=order.get) if order else 0
    by_pack = F.array(*[F.lit(i) for i in range(packs)]) if packs <= 64 else F.sequence(F.lit(0), F.lit(packs - 1))

    def meet(q, x):
        return q.groupBy("__pack", "__block").cogroup(x.groupBy("__pack", "__block")).applyInPandas(run, cells)

    q0 = queries.withColumn("__block", F.lit(top)).withColumn("__floor", F.lit(float("-inf")))
    x0 = ranged.filter(F.col("__block") == top).withColumn("__pack", F.explode(by_pack))
    first = materialize(meet(q0, x0), "topk-first")
    if len(heads) <= 1:
        found = first
    else:
        floor = first.groupBy("__quid").agg(F.min("score").alias("__least"), F.count("*").alias("__n"))
        bounded = queries.drop("__block").join(floor, F.col("__uid") == F.col("__quid"), "left").withColumn("__floor", F.when(F.col("__n") >= k, F.col("__least").cast("double")).otherwise(F.lit(float("-inf")))).drop("__least", "__n", "__quid")
        # how far down the blocks a pack has to go: to the last block whose longest vector may reach a query's bound
        reach = F.when(F.col("norm") > 0, (F.col("__floor") - 1e-6) / F.col("norm") * (1 - 1e-9)).otherwise(F.lit(float("-inf")))
        bounded = materialize(bounded, "bounded-queries")
        need = bounded.groupBy("__pack").agg(F.min(F.when(F.col("__floor") <= 0, F.lit(float("-inf"))).otherwise(reach)).alias("__reach"))

        def depth(batches):
            for pdf in batches:
                yield pdf.assign(__last=np.searchsorted(-longest, -pdf["__reach"].to_numpy(), side="right").astype("int64"))[["__pack", "__last"]]

        deep = need.mapInPandas(depth, "__pack int, __last long").filter("__last > 1").select("__pack", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__last") - 1)).alias("__place"))
        places = valid.sparkSession.createDataFrame([(i, r["__block"]) for i, r in enumerate(heads)], "__place long, __block int")
        met = materialize(deep.join(places, "__place").select(F.col("__pack").alias("__p"), "__block"), "meetings")
        q1 = bounded.join(met.withColumnRenamed("__p", "__pack"), "__pack")
        x1 = ranged.join(met.withColumnRenamed("__p", "__pack"), "__block")
        found = first.unionByName(meet(q1, x1))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("__quid").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
