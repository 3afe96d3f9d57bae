"""Quality classifier: random Fourier features, ridge from partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.quality_rules import SPACE
from quillon.llm.storage import materialize, table

THRESHOLD = 0.3
FOURIER = 256
RIDGE = 1e-3
SEED = 11
FOLDS = 16
#: Raw scores are counted in this many cells from LOW to HIGH for the calibration.
CELLS, LOW, HIGH = 2_000, -0.75, 1.75


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and __x, statistics of the whole text, all bounded or logarithms: sizes, shares of kinds of characters,
    repeated words and lines. Neither lang, source, doc_id nor n_chars enter. A null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    parts = docs.select(
        "doc_id",
        F.length(text).alias("__chars"),
        F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>")).alias("__words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        F.regexp_replace(text, r"[\p{Ll}\p{Lo}\p{Lm}\p{M}\x20\x09-\x0D]+", "").alias("__rest"),
    )
    words = F.size("__words").cast("double")
    letters = F.length(F.array_join("__words", "")).cast("double")
    rest, distinct = F.col("__rest"), F.size(F.array_distinct("__words")).cast("double")
    lines, own_lines = F.size("__lines").cast("double"), F.size(F.array_distinct("__lines")).cast("double")

    def share(n: Column, of: Column) -> Column:
        return F.when(of > 0, n / of).otherwise(F.lit(0.0))

    def less(pattern: str) -> Column:
        return (F.length(rest) - F.length(F.regexp_replace(rest, pattern, ""))).cast("double")

    x = [
        F.log1p(words),
        F.log1p(F.col("__chars").cast("double")),
        share(letters, words) / 10,
        F.log1p(lines),
        share(words, lines * 100),
        share(lines - own_lines, lines),
        share(distinct, words),
        share(F.log1p(distinct), F.log1p(words)),
        share(less(r"\p{Lu}+"), letters),
        share(less(r"\p{Nd}+"), letters),
        share(less(r"[#*$%&|<>]+"), words),
        share(less(r"[.,;:]+"), words),
        share(less(r"[!?]+"), words),
        share(F.length(F.regexp_replace(rest, r"[\p{Lu}\p{Nd}#*$%&|<>.,;:!?]+", "")).cast("double"), letters),
    ]
    return parts.select("doc_id", F.array(*x).alias("__x"))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the text null."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(5)).cast("int")


def _summed(df: DataFrame, size: int, add) -> "np.ndarray":  # noqa: F821
    """The sum over all rows of a fixed number of values: summed by partition, then in FOLDS parts, then here."""
    import numpy as np

    def by_partition(batches):
        import pandas as pd

        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += add(pdf)
        yield pd.DataFrame({"m": [total]})

    def fold(batches):
        import pandas as pd

        total = np.zeros(size)
        for pdf in batches:
            for m in pdf["m"]:
                total += m
        yield pd.DataFrame({"m": [total]})

    rows = df.mapInPandas(by_partition, "m array<double>").repartition(FOLDS).mapInPandas(fold, "m array<double>").collect()
    return sum((np.array(r["m"]) for r in rows), np.zeros(size))


def isotonic(n, y):
    """Pool adjacent violators over cells in order: a non-decreasing mean for each cell; cells without rows are nan."""
    import numpy as np

    blocks: list[list[float]] = []
    for i in np.flatnonzero(n):
        blocks.append([float(y[i]), float(n[i]), i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            a = blocks.pop()
            blocks.append([a[0] + b[0], a[1] + b[1], a[2], b[3]])
    out = np.full(len(n), np.nan)
    for total, count, first, last in blocks:
        out[first : last + 1] = total / count
    return out


def fit(known: DataFrame, fourier: int = FOURIER, ridge: float = RIDGE, seed: int = SEED) -> dict | None:
    """The model of known(doc_id, __x, __y): folds 2 to 4 of the ids fit the ridge, fold 1 calibrates; None without rows.

    What reaches the driver has a fixed size: moments of the statistics, the normal equations, counts by score cell.
    """
    import numpy as np

    first = known.limit(1).collect()
    if not first:
        return None
    dims = len(first[0]["__x"])
    fitted, calibrated = known.filter(F.col("__fold") != 1), known.filter(F.col("__fold") == 1)

    def moments(pdf):
        x = np.stack(pdf["__x"].to_numpy())
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    total = _summed(known, 1 + 2 * dims, moments)
    mean = total[1 : 1 + dims] / total[0]
    spread = np.sqrt(np.maximum(total[1 + dims :] / total[0] - mean**2, 0))
    spread[spread < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    model = {"mean": mean, "spread": spread, "w": rng.normal(size=(dims, fourier)) / math.sqrt(dims), "b": rng.uniform(0, 2 * math.pi, fourier)}
    size = fourier + dims + 1

    def equations(pdf):
        z, y = features(model, np.stack(pdf["__x"].to_numpy())), pdf["__y"].to_numpy(float)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y)]])

    sums = _summed(fitted, size * size + size + 1, equations)
    gram, right, n = sums[: size * size].reshape(size, size), sums[size * size : -1], max(sums[-1], 1.0)
    model["beta"] = np.linalg.solve(gram + ridge * n * np.eye(size), right)

    def cells(pdf):
        at = cell(features(model, np.stack(pdf["__x"].to_numpy())) @ model["beta"])
        y = pdf["__y"].to_numpy(float)
        return np.concatenate([np.bincount(at, minlength=CELLS), np.bincount(at, weights=y, minlength=CELLS)])

    counted = _summed(calibrated, 2 * CELLS, cells)
    steps = isotonic(counted[:CELLS], counted[CELLS:])
    known_cells = np.flatnonzero(~np.isnan(steps))
    centres = LOW + (np.arange(CELLS) + 0.5) * (HIGH - LOW) / CELLS
    model["at"], model["to"] = (centres[known_cells], steps[known_cells]) if len(known_cells) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def features(model: dict, x):
    """Random Fourier features of the standardised statistics, the statistics themselves and a constant."""
    import numpy as np

    z = np.clip((x - model["mean"]) / model["spread"], -5, 5)
    return np.concatenate([math.sqrt(2 / len(model["b"])) * np.cos(z @ model["w"] + model["b"]), z / 10, np.ones((len(x), 1))], axis=1)


def cell(raw):
    import numpy as np

    return np.clip(((raw - LOW) / (HIGH - LOW) * CELLS).astype(int), 0, CELLS - 1)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: doc_id, held_out, score (calibrated, 0 to 1), predicted and raw.

    docs needs doc_id and text, labels doc_id and quality; other columns are ignored. Labels are learnt only from rows
    whose crc32 of the id modulo 5 isn't 0; of several labels of a document the lowest of 0 and 1 counts, others don't.
    Without any label every score is 0.5. Repeated rows are scored each, an empty table gives none.
    """
    x = materialize(statistics(docs).withColumn("__fold", fold_of(F.col("doc_id"))), "quality-statistics")
    given = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").cast("double").alias("__y"))
    known = x.filter("__fold != 0").join(given, F.col("doc_id") == F.col("__id")).select("__x", "__y", "__fold")
    model = fit(materialize(known, "quality-known"))

    def score(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            if model is None:
                raw = prob = np.full(len(pdf), 0.5)
            else:
                raw = features(model, np.stack(pdf["__x"].to_numpy())) @ model["beta"] if len(pdf) else np.zeros(0)
                # the thousandth part keeps the raw order where the calibration is level
                prob = 0.999 * np.interp(raw, model["at"], model["to"]) + 0.001 * np.clip(raw, 0, 1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["__fold"] == 0, "score": np.clip(prob, 0, 1), "predicted": (prob >= THRESHOLD).astype("int32"), "raw": raw})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return x.mapInPandas(score, f"doc_id {id_type}, held_out boolean, score double, predicted int, raw double")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
