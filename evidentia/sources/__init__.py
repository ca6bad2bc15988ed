"""Sources and sinks: files, traces, flow logs, observations, reports, tool outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.triage import safe_name
from ..schemas import FLOW_FIELDS, OBSERVATIONS

UPLOAD_BYTES = 50 << 20
TRACE_LINES = 400_000


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(job_id, name, content, length) of files; see :func:`accepted` for the size rules."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.sha2(F.col("path"), 256).alias("job_id"), safe_name(F.col("path")).alias("name"), "length", "content")


def accepted(uploads: DataFrame, most: int = UPLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Uploads of 1 to ``most`` bytes, and the others with the code that says why (400 empty, 413 too large)."""
    size = F.octet_length("content")
    code = F.when(F.coalesce(size, F.lit(0)) == 0, 400).when(size > most, 413)
    return uploads.where(code.isNull()), uploads.where(code.isNotNull()).withColumn("code", code).drop("content")


def first_sample(listed: DataFrame) -> DataFrame:
    """The first file of each job by name."""
    return listed.groupBy("job_id").agg(F.min_by("name", "name").alias("name"))


def trace_lines(spark: SparkSession, path: str, most: int = TRACE_LINES) -> DataFrame:
    """(job_id, line_no, line) of trace files named by job; the first ``most`` lines of each file, empty ones left out.

    Files are read by line, wherever they are split, and numbered in the order of their blocks.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    # A block is read by one task, in order, so its lines have neighbouring numbers; blocks are few.
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"))
    earlier = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.join(blocks.withColumn("earlier", earlier), ["file", "block"]).withColumn("n", F.col("earlier") + F.col("at") - F.col("first") + 1).where(F.col("n") <= most)
    return numbered.select(F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("job_id"), F.col("n").alias("line_no"), "line").where("line != ''")


def flows(spark: SparkSession, path: str) -> DataFrame:
    """Flow events of JSON lines; broken lines and bad times are dropped."""
    rows = spark.read.schema(_columns(FLOW_FIELDS)).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("ts").try_cast("timestamp").isNotNull())


def _columns(fields: str):
    from ..schemas import ddl

    return ddl(fields)


def observations(raw: DataFrame, column: str = "value") -> DataFrame:
    """Observation records from JSON text; null columns where it is missing or broken."""
    return raw.withColumn("o", F.from_json(column, _columns(OBSERVATIONS), {"mode": "PERMISSIVE"})).select(*[c for c in raw.columns if c != column], "o.*")


def write(df: DataFrame, path: str, format: str = "parquet", by: str | None = None) -> None:
    """Tables of observations, reports or flows; the committer makes the write whole or not at all."""
    w = df.write.mode("append").format(format)
    (w.partitionBy(by) if by else w).save(path)


def listing_records(lines: DataFrame) -> DataFrame:
    """Entries of an archiver's ``key = value`` listing: (job_id, line_no, line) to (job_id, name, size, encrypted, folder).

    A record starts at each Path line; the running count of those lines is the record's number.
    """
    w = Window.partitionBy("job_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    key, value = F.trim(F.substring_index("line", " = ", 1)), F.regexp_replace("line", "^.*? = ", "")
    rows = lines.withColumn("k", key).withColumn("v", value).withColumn("rec", F.count_if(F.col("k") == "Path").over(w)).where("rec > 0 AND instr(line, ' = ') > 0")
    got = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    return rows.groupBy("job_id", "rec").agg(got("Path").alias("name"), got("Size").try_cast("long").alias("size"), (got("Encrypted") == "+").alias("encrypted"), F.startswith(got("Attributes"), F.lit("D")).alias("is_dir")).drop("rec")


def dde(output: Column) -> Column:
    """(found, links, output) of a DDE tool's JSON messages: typed links, or what follows the header."""
    entry = "array<struct<type:string,msg:string,data:string>>"
    rows = F.coalesce(F.from_json(F.regexp_extract(output, r"(?s)(\[.*)", 1), entry), F.array().cast(entry))
    said = F.transform(rows, lambda e: F.struct(F.lower(F.coalesce(e["type"], F.lit(""))).alias("t"), F.trim(F.coalesce(F.nullif(e["msg"], F.lit("")), e["data"], F.lit(""))).alias("m")))
    header = lambda e: ~e["t"].isin("dde", "dde-link") & F.contains(F.lower(e["m"]), F.lit("dde links:"))
    after = F.aggregate(said, F.struct(F.lit(False).alias("seen"), F.array().cast("array<string>").alias("l"), F.lit(False).alias("found")), lambda a, e: F.when(e["t"].isin("dde", "dde-link"), F.struct(a["seen"].alias("seen"), F.when(e["m"] != "", F.array_append(a["l"], e["m"])).otherwise(a["l"]).alias("l"), F.lit(True).alias("found"))).when(header(e), F.struct(F.lit(True).alias("seen"), a["l"].alias("l"), a["found"].alias("found"))).when(a["seen"] & (e["m"] != ""), F.struct(a["seen"].alias("seen"), F.array_append(a["l"], e["m"]).alias("l"), F.lit(True).alias("found"))).otherwise(a))
    return F.struct(after["found"].alias("found"), F.slice(after["l"], 1, 20).alias("links"), X.truncate(output, 2000).alias("output"))


def emulator_urls(iocs_json: Column, urls_json: Column) -> Column:
    """URLs of a script emulator's result files: url, src or file of each indicator, then the list of URLs; 60 at most."""
    iocs = F.coalesce(F.from_json(iocs_json, "array<struct<value:struct<url:string,src:string,file:string>>>"), F.array().cast("array<struct<value:struct<url:string,src:string,file:string>>>"))
    flat = F.flatten(F.transform(iocs, lambda i: F.array(i["value"]["url"], i["value"]["src"], i["value"]["file"])))
    return X.distinct(F.filter(F.concat(flat, F.coalesce(F.from_json(urls_json, "array<string>"), F.array().cast("array<string>"))), lambda u: u.isNotNull()), 60)
