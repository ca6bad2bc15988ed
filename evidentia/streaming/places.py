"""Where streams keep their checkpoints and what they write: below the folder that the session says all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def fresh(spark: SparkSession, name: str) -> str:
    """A folder of its own below spark.checkpoint.dir, or below the session's warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_streams"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
