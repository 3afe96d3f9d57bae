"""Incremental work: new documents by day, monthly totals, sessions; each as a Structured Streaming job or a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and values by arrival day and type; late rows within the watermark still count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("day"), "event_type", "n", "value")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream(spark: SparkSession, path: str, schema, files_a_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Processes what is there and stops; started again with the same checkpoint, it takes up new files only."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_new(df: DataFrame, target: str, checkpoint: str, key: str) -> None:
    """Appends rows with new keys to a Parquet table below `target`, a folder for each micro-batch.

    A key that an earlier batch brought is left out. A batch that runs again after a failure writes its own folder anew and
    is compared with the earlier ones only, so it neither repeats rows nor loses them.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        if number and _exists(spark, target):
            # earlier batches only, which the folder names say: this one's folder may hold a first attempt
            have = spark.read.parquet(target).filter(F.col("batch") < number).select(key)
            fresh = fresh.join(have, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")

    df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def committed(df: DataFrame, target: str, rows: int = 25) -> list[str]:
    """Writes df in parts of about `rows` rows each, so that what is done survives a stop; returns the parts' folders. Parts are
    dealt by a hash of the row, so a rerun writes the same ones."""
    parts = max(1, -(-df.count() // rows))
    dealt = df.withColumn("part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    dealt.write.mode("overwrite").partitionBy("part").parquet(target)
    return sorted(f"{target}/part={i}" for i in range(parts) if _exists(df.sparkSession, f"{target}/part={i}"))


def stale(docs: DataFrame, index: DataFrame, rules_hash: str) -> DataFrame:
    """Documents without an index row of the present text and rules: what an incremental run has to do."""
    now = docs.withColumn("h", F.sha2(F.concat_ws("|", F.lit(rules_hash), "text"), 256))
    return now.join(index.select("doc_id", "h"), ["doc_id", "h"], "left_anti").drop("h")
