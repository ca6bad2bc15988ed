"""Network evidence: flow events matched with jobs by source address and time window, then split, deduplicated and capped."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import FLOW_FIELDS, NETWORK, ddl

CAP = 120
FIELDS = re.findall(r"(\w+):", FLOW_FIELDS)


#: Seconds of a bin of time, by which the flows and jobs of one address are parted.
BIN_SECONDS = 3600


def _bin(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at) / F.lit(seconds * 1_000_000))


def match(flows: DataFrame, jobs: DataFrame, src: str = "src", ts: str = "ts", bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """Flows (src, ts, ...) of jobs (job_id, worker_ip, started_at, finished_at), both ends of the window included.

    The keys are the address and a bin of time: a flow lies in one bin, a job in each that its window touches. So an
    address that is used over and over, by many jobs, is parted by time, and a flow only meets the jobs of its own bin.
    Spark may broadcast the jobs or shuffle by the keys.
    """
    j = jobs.select("job_id", F.col("worker_ip").alias("_ip"), F.col("started_at").cast("timestamp").alias("_from"), F.col("finished_at").cast("timestamp").alias("_to"))
    j = j.where("_from <= _to").withColumn("_bin", F.explode(F.sequence(_bin(F.col("_from"), bin_seconds), _bin(F.col("_to"), bin_seconds))))
    f = flows.withColumn("_at", F.col(ts).try_cast("timestamp")).withColumn("_of", _bin(F.col("_at"), bin_seconds))
    met = (F.col(src) == F.col("_ip")) & (F.col("_of") == F.col("_bin")) & F.col("_at").between(F.col("_from"), F.col("_to"))
    return f.join(j, met).drop("_ip", "_from", "_to", "_bin", "_at", "_of")


KINDS = {"dns_queries": ("dns",), "http_requests": ("http", "http_connect"), "tcp_sessions": ("tcp",)}


def collect(flows: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, network) of every job; empty lists without flows. ``flows`` may have ``_seq``, its order in the log.

    Flows of a kind are ranked and cut to ``CAP`` before they are gathered, so no row holds more.
    """
    if "_seq" not in flows.columns:
        flows = flows.withColumn("_seq", F.struct(F.col("ts").try_cast("timestamp"), F.to_json(F.struct(*FIELDS))))
    kind = reduce(lambda out, item: out.when(F.col("kind").isin(*item[1]), item[0]), KINDS.items(), F)
    m = match(flows, jobs).withColumn("_list", kind)
    ranked = m.where("_list IS NOT NULL").withColumn("_k", F.row_number().over(Window.partitionBy("job_id", "_list").orderBy("_seq"))).where(F.col("_k") <= CAP)
    of = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("_list") == name, F.struct("_k", F.struct(*FIELDS).alias("v")))), lambda a, b: a["_k"] - b["_k"]), lambda r: r["v"]).alias(name)
    lists = ranked.groupBy("job_id").agg(*map(of, KINDS))
    name = F.when(F.col("kind") == "dns", F.col("qname")).when(F.col("kind").isin(*KINDS["http_requests"]), F.col("host"))
    hosts = m.select("job_id", name.alias("h")).where("h <> ''").groupBy("job_id").agg(F.array_sort(F.collect_set("h")).alias("contacted_hosts"))
    net = jobs.select("job_id").join(lists, "job_id", "left").join(hosts, "job_id", "left")
    empty = F.array()
    return net.select(
        "job_id",
        F.struct(*[F.coalesce(F.col(c), empty.cast(t)).alias(c) if c in net.columns else empty.cast(t).alias(c) for c, t in ((f.name, f.dataType.simpleString()) for f in ddl(f"network:{NETWORK}")[0].dataType)]).alias("network"),
    )


def distinct_connects(connects: Column, *infra: Column) -> Column:
    """Connects to the sample's own destinations, the first of each address and port, capped."""
    own = F.filter(connects, lambda c: ~X.is_infra_ip(c["ip"], *infra))
    keys = F.transform(own, lambda c: F.struct(c["ip"], c["port"]))
    firsts = F.filter(F.transform(own, lambda c, i: F.struct(c.alias("c"), (F.array_position(keys, F.struct(c["ip"], c["port"])) == i + 1).alias("first"))), lambda r: r["first"])
    return F.slice(F.transform(firsts, lambda r: r["c"]), 1, CAP)


def distinct_queries(queries: Column) -> Column:
    """The first query of each name."""
    names = F.transform(queries, lambda q: F.coalesce(q["qname"], F.lit("")))
    firsts = F.filter(F.transform(queries, lambda q, i: F.struct(q.alias("q"), (F.array_position(names, F.coalesce(q["qname"], F.lit(""))) == i + 1).alias("first"))), lambda r: r["first"])
    return F.transform(firsts, lambda r: r["q"])
