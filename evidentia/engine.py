"""The engine's surface: submit files or observations, get reports, list and remove jobs, list rules."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import sources
from .operators import jobs as J
from .operators import network, recorded, report, rules, static, trace, triage
from .schemas import DYNAMIC, NETWORK, ddl


class Engine:
    """Reports live in a table of files at ``path``, partitioned by day; reading and judging are plain DataFrames."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def observe(self, files: DataFrame, traces: DataFrame | None = None, flows: DataFrame | None = None, job_table: DataFrame | None = None, launchers: DataFrame | None = None, listings: DataFrame | None = None, outputs: DataFrame | None = None) -> DataFrame:
        """Observations of ``files`` (job_id, name, content), with what was recorded about them if there is any.

        ``traces`` and ``launchers`` are as :func:`trace.summarize` takes them, ``flows`` and ``job_table`` as :func:`network.collect`
        does; ``job_table`` may also say how each job ended (error, timed_out, worker_status). ``listings`` are lines of an
        archiver's listing, and ``outputs`` a row of tool outputs for each job, see :func:`recorded.apply`.
        """
        listed = None if listings is None else sources.listing_records(listings)
        obs = static.analyze(triage.triage(files), listed).select("job_id", "file", "static", "errors")
        if traces is not None:
            d = trace.summarize(traces, launchers)
            fields = {f.name: f.dataType for f in ddl(f"d:{DYNAMIC}")[0].dataType}
            known = F.struct(*[(F.col(k) if k in d.columns else F.lit(True) if k == "executed" else F.lit(None)).cast(t).alias(k) for k, t in fields.items()])
            obs = obs.join(d.select("job_id", known.alias("dynamic")), "job_id", "left")
        else:
            obs = obs.withColumn("dynamic", F.lit(None).cast(DYNAMIC))
        obs = recorded.apply(obs, outputs)
        if job_table is not None:
            ends = [c for c in ("worker_ip", "dns", "error", "timed_out", "worker_status") if c in job_table.columns]
            obs = obs.join(job_table.select("job_id", *ends), "job_id", "left")
        if flows is not None and job_table is not None:
            return obs.join(network.collect(flows, job_table), "job_id", "left")
        return obs.withColumn("network", F.lit(None).cast(NETWORK))

    def analyze(self, files: DataFrame, **recorded) -> DataFrame:
        return report.build(self.observe(files, **recorded))

    def rescore(self, observations: DataFrame, rule_list=None) -> DataFrame:
        """Reports of archived observations under other rules."""
        return report.build(observations, rule_list)

    def submit(self, files: DataFrame, **recorded) -> None:
        done = self.analyze(files, **recorded).withColumn("day", F.current_date()).withColumn("submitted", F.current_timestamp())
        done.write.mode("append").partitionBy("day").parquet(self.path)

    def reports(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def report(self, job_id: str, live: DataFrame | None = None) -> DataFrame:
        """A job's report: the one among ``live`` reports, else the stored one."""
        return self.reports().where(F.col("job_id") == job_id) if live is None else J.lookup(live, self.reports(), job_id)

    def jobs(self, limit: int = 50) -> DataFrame:
        return J.listing(self.reports().select("job_id", "status", "verdict.level", "verdict.score", "submitted"), limit, "submitted")

    def active(self, statuses: DataFrame) -> int:
        """Jobs that are queued or running; ``statuses`` as :func:`life.batch` and :func:`life.latest` give them."""
        return J.active(statuses).first()[0]

    def wait_for(self, job_id: str, poll_interval: float = 2.0, max_wait: float = 300) -> Row:
        """The job's report, once it's stored; TimeoutError if that takes too long."""
        until = time.monotonic() + max_wait
        while True:
            if self._exists() and (found := self.report(job_id).first()):
                return found
            if time.monotonic() >= until:
                raise TimeoutError(f"job {job_id} did not finish within {max_wait}s")
            time.sleep(min(poll_interval, max(0.0, until - time.monotonic())))

    def _exists(self) -> bool:
        """Whether a write of reports has ended; the folder alone is there before that."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path, "_SUCCESS")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def delete(self, job_id: str) -> bool:
        """Removes a job's reports where they lie: only its days' folders are written again, each replaced once it's whole."""
        found = self.reports()
        days = [r.day for r in found.where(F.col("job_id") == job_id).select("day").distinct().collect()]  # a few days
        for day in days:
            rest = found.where((F.col("day") == F.lit(day)) & (F.col("job_id") != job_id))
            if rest.isEmpty():
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/day={day}")
                path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
            else:
                rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)
        return bool(days)

    def rules(self) -> DataFrame:
        return rules.catalogue(self.spark)
