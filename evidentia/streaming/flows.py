"""Flow logs as streams: the same match of flows with jobs, with watermarks, an exactly-once log, and scores in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report
from ..schemas import FLOW_FIELDS, ddl

#: Longer than the longest job (180 s and slack), so a flow isn't late while its job can still end.
WATERMARK = "10 minutes"


def read(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Flow events of new JSON files; broken lines are dropped. ``at`` is the event's time."""
    rows = spark.readStream.schema(ddl(FLOW_FIELDS)).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", per_trigger).json(path)
    return rows.withColumn("at", F.col("ts").try_cast("timestamp")).where("at IS NOT NULL").withWatermark("at", WATERMARK)


def matched(flows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Flows within their jobs' windows, both ends included; ``jobs`` is a table or a stream with a watermark of its own."""
    j = jobs.select("job_id", F.col("worker_ip").alias("_ip"), F.col("started_at").cast("timestamp").alias("_from"), F.col("finished_at").cast("timestamp").alias("_to"))
    return flows.join(j, (F.col("src") == F.col("_ip")) & (F.col("at") >= F.col("_from")) & (F.col("at") <= F.col("_to"))).drop("_ip", "_from", "_to")


def interval_joined(flows: DataFrame, jobs: DataFrame, longest: str, src: str = "src", at: str = "at") -> DataFrame:
    """A stream of flows with a stream of jobs; both have watermarks, flows on ``at`` and jobs on ``started_at``.

    No job lasts longer than ``longest``, so a flow waits for its job, and a job for its flows, no longer than that: what lies
    further behind the watermarks leaves the state. Rows that come later than the watermarks allow don't count.
    """
    j = jobs.select("job_id", F.col("worker_ip").alias("_ip"), F.col("started_at").alias("_from"), F.col("finished_at").alias("_to"))
    inside = (F.col(at) >= F.col("_from")) & (F.col(at) <= F.col("_from") + F.expr(f"INTERVAL {longest}")) & (F.col(at) <= F.col("_to"))
    return flows.join(j, (F.col(src) == F.col("_ip")) & inside).drop("_ip", "_from", "_to")


def write_batch(flows: DataFrame, batch: int, path: str) -> None:
    """Flow events as JSON lines in the batch's own folder, so a batch that runs again replaces itself."""
    flows.write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch:012d}")


def append_log(flows: DataFrame, path: str):
    """A writer that appends each micro-batch to the log at ``path`` exactly once, given a checkpoint."""
    return flows.writeStream.foreachBatch(lambda df, n: write_batch(df, n, path))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The flow events of all batches; broken lines are dropped."""
    return spark.read.schema(ddl(FLOW_FIELDS)).option("mode", "DROPMALFORMED").json(path).drop("batch")


#: The store that keyed state with timers needs; joins do with the default, which keeps fewer files.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def finish(stream: DataFrame, work: str, store: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote, as a table below ``work``."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, store or before)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{work}/out")


def counts(flows: DataFrame, window: str = "1 hour") -> DataFrame:
    """Events by source, kind and tumbling window."""
    return flows.groupBy(F.window("at", window).alias("w"), "src", "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "src", "kind", "n")


def score_batches(observations: DataFrame, sink: Callable[[DataFrame, int], None]):
    """A writer that judges each micro-batch of observations and hands the reports to ``sink``."""
    return observations.writeStream.foreachBatch(lambda df, n: sink(report.build(df), n))
