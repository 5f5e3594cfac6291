"""Streams of events: sliding windows, alerts, deduplication and merging of micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """A stream of the parquet file or folder at path, with the schema that it has now; ts as an instant."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may name a single file, a plain path only a folder
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_batch).parquet(pattern)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def shared(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root or 'file:///tmp/attesta-checkpoints'}/attesta-stream/{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """rows, written to a new shared folder and read back: for what several steps read and that is dear to compute."""
    folder = shared(rows.sparkSession)
    rows.write.parquet(folder)
    out = rows.sparkSession.read.schema(rows.schema).parquet(folder)
    out._written_to = folder
    return out


def gone(*frames: DataFrame) -> None:
    """Remove the files of frames that written gave and that nothing reads any more."""
    for df in frames:
        if folder := getattr(df, "_written_to", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that the stream has now, written to the shared folder, and read back."""
    spark, folder = stream.sparkSession, shared(stream.sparkSession)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_merged(stream: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> DataFrame:
    """The table that remains when each micro-batch is merged into it; each version is a new folder."""
    spark, folder, state = stream.sparkSession, shared(stream.sparkSession), {"table": None}

    def step(batch: DataFrame, epoch: int) -> None:
        out = f"{folder}/v{epoch}"
        merge(state["table"], batch).write.mode("overwrite").parquet(out)
        state["table"] = spark.read.parquet(out)

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return state["table"]


def sliding_counts(table: DataFrame | None, batch: DataFrame, width: str = "7 days", step: str = "1 day") -> DataFrame:
    """Counts per sliding window and type, merged with those of earlier batches; no row is too late."""
    new = batch.groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    if table is None:
        return new
    return table.unionByName(new).groupBy("start", "event_type").agg(F.sum("n").alias("n"))


def first_last(table: DataFrame | None, batch: DataFrame) -> DataFrame:
    """First and last moment per key, merged with those of earlier batches."""
    new = batch.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    if table is None:
        return new
    return table.unionByName(new).groupBy("user_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"))


def run_portions(stream: DataFrame, size: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `work` gives for (portion, *columns) of the stream; a portion has at most `size` rows of one task of one batch.

    Each batch is written to a folder of its own number, so that a batch that is done again replaces what it had written.
    """
    spark, folder = stream.sparkSession, shared(stream.sparkSession)

    def step(batch: DataFrame, epoch: int) -> None:
        at = F.monotonically_increasing_id()
        task, within = F.shiftrightunsigned(at, 33), at.bitwiseAND((1 << 33) - 1)
        portions = batch.withColumn("portion", F.struct(F.lit(epoch).alias("batch"), task.alias("task"), (within / size).cast("long").alias("number")))
        work(portions).write.mode("overwrite").parquet(f"{folder}/out/batch={epoch}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/*").drop("batch")
