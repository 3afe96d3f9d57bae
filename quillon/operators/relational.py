"""Join, window and aggregate shapes that the analyses share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(asked: DataFrame, known: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """asked with the value of the last row of known with the same key and known.at <= asked.at.

    One pass: both sides are stacked and sorted once by (key, at), and the last value seen is carried forward; no
    row meets another. Of several known rows at one time the greatest value counts.
    """
    left = asked.withColumns({"__is": F.lit(1), "__v": F.lit(None).cast(known.schema[value].dataType)})
    right = known.groupBy(key, at).agg(F.max(value).alias("__v")).withColumn("__is", F.lit(0))
    order = Window.partitionBy(key).orderBy(at, "__is").rowsBetween(Window.unboundedPreceding, 0)
    stacked = left.unionByName(right, allowMissingColumns=True)
    return stacked.withColumn(value, F.last("__v", ignorenulls=True).over(order)).filter("__is = 1").drop("__is", "__v")


def nearest_second(at: Column) -> Column:
    """The second that a time is nearest to, since 1970; halves go to the even one."""
    return F.rint(F.unix_micros(at.cast("timestamp")) / 1e6).cast("long")


def band_pairs(marks: DataFrame, group: str, at: str, who: str, width: int, mark: str | None = None) -> DataFrame:
    """group, a, b, n: for each mark, each other `who` that has a mark within `width` after it counts once.

    Rows with the same value of the column `mark` are one mark; without it each row is one. Marks at one place go by name. A
    mark probes its own cell of `width` places and the next one, an equi-join, so a long document isn't joined with itself.
    """
    cell = F.floor(F.col(at) / width)
    numbered = marks.withColumn("mark", F.col(mark) if mark else F.monotonically_increasing_id())  # before the probes: both are of one mark
    left = numbered.select(group, "mark", F.col(at).alias("p"), F.col(who).alias("x"), F.array(cell, cell + 1).alias("cells")).select("*", F.explode("cells").alias("cell"))
    right = marks.select(F.col(group).alias("g"), F.col(at).alias("q"), F.col(who).alias("y"), cell.alias("c"))
    near = left.join(right, (F.col(group) == F.col("g")) & (F.col("cell") == F.col("c"))).filter("x <> y and q - p between 0 and " + str(width)).filter("q > p or y > x")
    once = near.select(group, "mark", "x", "y").distinct()
    return once.groupBy(group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def dense_years(counted: DataFrame, first: int, last: int, value: str, year: str = "year") -> DataFrame:
    """A row for each year from first to last; 0 where counted has none."""
    spine = counted.sparkSession.range(first, last + 1).withColumnRenamed("id", year)
    return spine.join(counted, year, "left").withColumn(value, F.coalesce(value, F.lit(0).cast("long")))


def percent_position(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """The place in its group from 0 to 1; tied rows have places of their own, unlike percent_rank."""
    w = Window.partitionBy(*keys)
    place = (F.row_number().over(w.orderBy(*order)) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))
    return df.withColumn(name, F.round(place, 4))


def upper_median(column: str) -> Column:
    """The upper of the two middle values, not their mean."""
    values = F.sort_array(F.collect_list(column))
    return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def upsert(old: DataFrame, new: DataFrame, key: str, active: str = "active") -> DataFrame:
    """new's rows and, switched off, those of old that vanished: the register's sync."""
    gone = old.join(new.select(key), key, "left_anti").withColumn(active, F.lit(False))
    return new.unionByName(gone, allowMissingColumns=True)


def shuffled_order(doc: Column, name: Column) -> Column:
    """A fixed pseudo-random order."""
    return (doc * 2_654_435_761 + name) % 1_000_003


def compare(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, state (new, gone, up, down, same), before, after."""
    a, b = old.select(*key, F.col(value).alias("before")), new.select(*key, F.col(value).alias("after"))
    state = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("after") > F.col("before"), "up").when(F.col("after") < F.col("before"), "down").otherwise("same")
    return a.join(b, key, "full_outer").withColumn("state", state)


def merge(ours: DataFrame, theirs: DataFrame, key: str, columns: list[str], by_hand: str | None = None, prefer: str = "ours") -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): missing rows are added, nulls filled, a value by hand wins, else `prefer` does; differing
    values are listed."""
    o = ours.select(F.col(key), *[F.col(c).alias(f"o_{c}") for c in columns], *([F.col(by_hand).alias("hand")] if by_hand else [F.lit(False).alias("hand")]))
    t = theirs.select(F.col(key), *[F.col(c).alias(f"t_{c}") for c in columns])
    both = o.join(t, key, "full_outer")
    order = (lambda c: (f"o_{c}", f"t_{c}")) if prefer == "ours" else (lambda c: (f"t_{c}", f"o_{c}"))
    merged = both.select(key, *[F.when(F.col("hand"), F.coalesce(f"o_{c}", f"t_{c}")).otherwise(F.coalesce(*order(c))).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").cast("string").alias("ours"), F.col(f"t_{c}").cast("string").alias("theirs")) for c in columns]))
    conflicts = both.select(key, pairs.alias("x")).select(key, "x.*").filter("ours <> theirs")
    return merged, conflicts
