"""The job table: listing, lookup, retention, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETENTION_HOURS = 24


def listing(jobs: DataFrame, limit: int, seq: str = "seq") -> DataFrame:
    """The latest jobs, newest first; a limit of 0 lists all, as it takes a tail from its start."""
    ordered = jobs.orderBy(F.desc(seq))
    return ordered if limit == 0 else ordered.limit(limit)


def expired(jobs: DataFrame, now: Column, modified: str = "modified_at", hours: int = RETENTION_HOURS) -> DataFrame:
    """Jobs strictly older than the retention; removing them is the caller's explicit step."""
    return jobs.where(F.col(modified) < now - F.expr(f"INTERVAL {hours} HOURS"))


def lookup(live: DataFrame, stored: DataFrame, job_id: str) -> DataFrame:
    """A job's report: the live one, else the stored one."""
    key = F.col("job_id") == job_id
    return live.where(key).withColumn("_o", F.lit(0)).unionByName(stored.where(key).withColumn("_o", F.lit(1)), allowMissingColumns=True).orderBy("_o").limit(1).drop("_o")


def statistics(reports: DataFrame) -> DataFrame:
    """Batch counts: total, passed, failed, skipped."""
    s = F.col("status")
    return reports.agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "completed").alias("passed"), F.count_if(s.isin("failed", "timeout")).alias("failed"), F.count_if(s == "skipped").alias("skipped"))


def active(jobs: DataFrame) -> DataFrame:
    """How many jobs are queued or running."""
    return jobs.agg(F.count_if(F.col("status").isin("queued", "running")).alias("active_jobs"))


def attachments(emails: DataFrame, reports: DataFrame) -> DataFrame:
    """A row for each attachment (email_id, job_id) with its report's level; UNKNOWN where there is none."""
    r = reports.select("job_id", F.col("verdict.level").alias("level"))
    return emails.join(r, "job_id", "left").withColumn("level", F.coalesce("level", F.lit("UNKNOWN")))
