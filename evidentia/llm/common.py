"""What the corpus operators share: words, seeded splits, and tables cut off from their lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda inside ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a folder of the session's own warehouse only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back: lineage ends here and lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the folders of tables made by :func:`cut` whose last reader is done."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._cut_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def named(column: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(name: str, columns: list[str]) -> str:
    """``name``, or with underscores in front until no column has it; column names don't tell case apart."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of each row's own in column ``name``, written down so that it stays the same."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()))
