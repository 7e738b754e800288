"""Event streams: windowed counts with watermarks, latest state, and incremental upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The current state of each item: its last event, as one aggregation with partial maxima."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_s")).select(key, "_s.*")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and type; repeats of an event id inside the watermark count once."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    else:
        timed = timed.dropDuplicates(["event_id"])
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def work_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder; in local mode without one, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="lodestone-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def windowed_counts_of_files(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """The same as a stream over the files of ``path``, run to the end, with every window.

    The stream appends windows that the watermark has closed to files. Those that it leaves open are counted from the
    events after the watermark, which a filter on their time reads.
    """
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(SCHEMA).option("pathGlobFilter", name).parquet(folder)
    work = work_folder(spark)
    run = windowed_counts(stream, late=late).writeStream.outputMode("append").format("parquet").option("path", f"{work}/closed").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    closed = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{work}/closed")
    marks = [p["eventTime"]["watermark"] for p in run.recentProgress if "watermark" in p.get("eventTime", {})]
    events = spark.read.schema(SCHEMA).option("pathGlobFilter", name).parquet(folder)
    if marks:  # windows of an hour that end after the watermark hold events from an hour before it at most
        mark = F.to_timestamp(F.lit(max(marks)))
        events = events.where(F.col("ts").cast("timestamp") >= mark - F.expr("INTERVAL 1 HOUR"))
        rest = windowed_counts(events).where(F.col("start") + F.expr("INTERVAL 1 HOUR") > mark)
    else:
        rest = windowed_counts(events)
    return closed.unionByName(rest.join(closed.select("start", "event_type"), ["start", "event_type"], "left_anti"))


def upsert(current: DataFrame | None, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The state after a batch: the newest row of each key; rows of the batch win ties."""
    tagged = batch.withColumn("_new", F.lit(1))
    both = tagged if current is None else current.withColumn("_new", F.lit(0)).unionByName(tagged)
    rest = [c for c in batch.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order, "_new")).alias("_s")).select(key, "_s.*").select(*batch.columns)


def run_state(stream: DataFrame, folder: str, key: str, order: list[str]):
    """Keep the latest state of each key under ``folder``, a new version for each micro-batch; a repeated batch writes the same version."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(batch.schema).parquet(f"{folder}/v{number - 1}") if number else None
        upsert(before, batch, key, order).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()
