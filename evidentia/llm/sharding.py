"""Sharding by histogram sort, in DataFrame expressions alone.

Rows are ordered by ``(xxhash64(text), doc_id)``, so equal texts are neighbours, and that order is cut into shards of
nearly equal bytes. Boundaries come from exact counts: a first pass counts rows and bytes below 1,024 equally spaced
key boundaries; each further pass splits, at ``PROBES`` boundaries inside the range of keys it really holds, every
bucket that still hides a splitter, or that is much larger than its fellows (a group of copies is split by doc_id).
It ends when every splitter is within ``TOLERANCE`` of a shard's bytes from its target, or the bucket holds one key.
Then buckets of more than ``CELL_BYTES`` are dealt into cells of about as many, in the order of keys, by tables that
stay on the cluster, and the rows are exchanged once, by cell: a task's window holds a cell, however large the corpus.
A row's slot is its rank in its cell plus the rows of earlier cells of the shard. Only bucket totals reach the driver:
1,024, and ``PROBES`` for each bucket that is split, of which one pass has at most ``shards - 1`` and a few hundred
large ones, whatever the number of rows. Passes count narrow keys, written once; texts are read to make the keys and
for the exchange.

Null text: 0 bytes, hashed as the null it is. Null doc_id sorts first. Repeated rows tie: they lie in one cell and
their slots are given in any order. With an empty table there are no buckets and no rows. Extra columns ride along,
whatever their names; those named ``shard`` and ``slot`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, forget, named, table

SHARDS = 24
PROBES = 16
BITS = 10
TOLERANCE = 0.002
ROW_BYTES = 8
#: A bucket is split while it has more than this share of all rows, and more rows than FEW_ROWS.
LARGE, FEW_ROWS, MAX_PASSES = 1 / 384, 64, 40
#: Bytes that a cell, which is one task's work, may hold if its keys differ; a pass cuts a cell into CUTS at most.
CELL_BYTES, CUTS = 128 << 20, 1024
LEAST = -(1 << 63)


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def keys_of(text: Column, doc: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_h"), F.coalesce(doc.cast("long"), F.lit(LEAST)).alias("_d"), size_of(text).alias("_size")]


def _bucketed(keys: DataFrame) -> DataFrame:
    return keys.withColumn("_b", F.shiftright(F.col("_h"), 64 - BITS) + F.lit(1 << (BITS - 1)))


def _probe(keys: DataFrame, level: list[dict]) -> DataFrame:
    """Gives rows of the buckets in ``level`` the bucket of their key among that bucket's probes."""
    values = ", ".join(f"({x['id']}L, {x['base']}L, {'true' if x['on'] == '_h' else 'false'}, {x['lo']}D, {x['step']!r}D)" for x in level)
    split = F.broadcast(keys.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(_b, _base, _on_h, _lo, _step)"))  # a row for each bucket that is split
    at = F.when(F.col("_on_h"), F.col("_h")).otherwise(F.col("_d")).cast("double")
    sub = F.least(F.lit(PROBES - 1), F.floor((at - F.col("_lo")) / F.col("_step"))).cast("long")
    return keys.join(split, "_b", "left").withColumn("_b", F.coalesce(F.col("_base") + F.greatest(sub, F.lit(0).cast("long")), F.col("_b"))).drop("_base", "_on_h", "_lo", "_step")


def _counted(keys: DataFrame, *by: str) -> DataFrame:
    return keys.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum("_size").alias("bytes"), *[f(c).alias(f"{n}{c}") for c in ("_h", "_d") for n, f in (("min", F.min), ("max", F.max))])


def _totals(keys: DataFrame) -> list[dict]:
    return [r.asDict() for r in _counted(keys, "_b").collect()]  # bounded: see the module's text


def _divides(lo: int, hi: int) -> dict | None:
    """Probes between two keys, as doubles; None where doubles can't tell them apart."""
    step = (float(hi) - float(lo)) / PROBES
    return {"lo": repr(float(lo)), "step": step} if step > 0 and float(lo) + step > float(lo) else None


def plan(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[list[dict]], list[tuple[int, int, int]], int]:
    """For ``keys`` (_h, _d, _size): those with the bucket ``_b`` of each row, the probes of each pass, (bucket, shard, rows
    before it in the shard), and the bytes of the largest bucket."""
    keys, levels = _bucketed(keys), []
    order = _totals(keys)
    order.sort(key=lambda x: x["_b"])
    total, rows = sum(x["bytes"] for x in order), sum(x["rows"] for x in order)
    allowed, fresh = tolerance * total / shards, 1 << BITS
    for _ in range(MAX_PASSES):
        level, below = [], 0
        for x in order:
            hit = {k for k in range(max(1, below * shards // max(total, 1)), shards) if below < k * total / shards < below + x["bytes"] and min(k * total / shards - below, below + x["bytes"] - k * total / shards) > allowed}
            below += x["bytes"]
            if (hit or x["rows"] > max(FEW_ROWS, LARGE * rows)) and x["rows"] > 1:
                on = "_h" if x["min_h"] != x["max_h"] else "_d"
                if probes := _divides(x[f"min{on}"], x[f"max{on}"]):
                    level.append({"id": x["_b"], "base": fresh, "on": on} | probes)
                    fresh += PROBES
        if not level:
            break
        levels.append(level)
        keys = _probe(keys, level)
        parents = {x["id"]: x["base"] for x in level}
        ids = [x["base"] + i for x in level for i in range(PROBES)]
        found = {x["_b"]: x for x in _totals(keys.where(F.col("_b") >= ids[0]))}
        order = [y for x in order for y in ([found[parents[x["_b"]] + i] for i in range(PROBES) if parents[x["_b"]] + i in found] if x["_b"] in parents else [x])]
    placed, below, shard, before = [], 0, 0, 0
    for x in order:
        while shard < shards - 1 and below + x["bytes"] / 2 >= (shard + 1) * total / shards:
            shard, before = shard + 1, 0
        placed.append((x["_b"], shard, before))
        below, before = below + x["bytes"], before + x["rows"]
    return keys, levels, placed, max((x["bytes"] for x in order), default=0)


def _dealt(keys: DataFrame, large: DataFrame) -> DataFrame:
    """Gives rows of the cells in ``large`` the cell of their key among that cell's cuts; names of cells sort like their keys."""
    at = F.when(F.col("_on_h"), F.col("_h")).otherwise(F.col("_d")).cast("double")
    sub = F.greatest(F.least(F.col("_cuts") - 1, F.floor((at - F.col("_lo")) / F.col("_step"))), F.lit(0))
    name = F.when(F.col("_cuts").isNull(), F.col("_c")).otherwise(F.concat("_c", F.lpad(F.hex(sub.cast("long")), 3, "0")))
    return keys.join(large, ["_b", "_c"], "left").withColumn("_c", name).drop("_on_h", "_lo", "_step", "_cuts")


def _cells(keys: DataFrame, places: DataFrame, cell_bytes: int) -> tuple[list[DataFrame], DataFrame]:
    """The cuts of each pass, and (bucket, cell, shard, rows before it in the shard)."""
    steps = []
    at = keys.withColumn("_c", F.lit(""))
    while True:
        found = cut(_counted(at, "_b", "_c"))
        on_h = F.col("min_h") != F.col("max_h")
        end = lambda n: F.when(on_h, F.col(f"{n}_h")).otherwise(F.col(f"{n}_d")).cast("double")
        cuts = F.least(F.lit(CUTS), F.ceil(F.col("bytes") / cell_bytes) + 1)
        large = found.where(F.col("bytes") > cell_bytes).select("_b", "_c", on_h.alias("_on_h"), end("min").alias("_lo"), ((end("max") - end("min")) / cuts).alias("_step"), cuts.alias("_cuts"))
        large = cut(large.where("_lo + _step > _lo"))
        if large.isEmpty():
            earlier = Window.partitionBy("_b").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
            placed = found.withColumn("_earlier", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).join(places, "_b")
            return steps, placed.select("_b", "_c", "_shard", (F.col("_before") + F.col("_earlier")).alias("_before"))
        steps.append(large)
        forget(found)
        at = _dealt(at, large)


def placed(rows: DataFrame, keys: DataFrame, shards: int, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``rows`` (row, _h, _d, _size) with their ``shard`` and ``slot``, by counts of their ``keys`` (_h, _d, _size)."""
    keys, levels, places, most = plan(keys, shards)
    if not places:
        return rows.select("row", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    values = ", ".join(f"({b}L, {s}, {n}L)" for b, s, n in places)
    buckets = F.broadcast(rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(_b, _shard, _before)"))  # a row for each bucket
    steps, cells = _cells(keys, buckets, cell_bytes) if most > cell_bytes else ([], F.broadcast(buckets.withColumn("_c", F.lit(""))))
    rows = _bucketed(rows)
    for level in levels:
        rows = _probe(rows, level)
    rows = rows.withColumn("_c", F.lit(""))
    for large in steps:
        rows = _dealt(rows, large)
    rank = F.row_number().over(Window.partitionBy("_b", "_c").orderBy("_h", "_d"))
    return rows.withColumn("_rank", rank).join(cells, ["_b", "_c"]).select("row", F.col("_shard").alias("shard"), (F.col("_before") + F.col("_rank") - 1).alias("slot"))


def shard(df: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id", cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``df`` plus ``shard`` and ``slot``; columns of ``df`` with those names are replaced."""
    made = keys_of(F.col(text), F.col(key))
    keys = cut(df.select(*made))
    own = F.struct(*[named(c).alias(c) for c in df.columns if c.lower() not in ("shard", "slot")])
    out = placed(df.select(own.alias("row"), *made), keys, shards, cell_bytes).select("row.*", "shard", "slot")
    forget(keys)
    return out


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    out = F.struct("doc_id", size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    rows = cut(docs.select(out.alias("row"), *keys_of(text, F.col("doc_id"))))  # no texts: they are read once
    found = placed(rows, rows.select("_h", "_d", "_size"), SHARDS)
    return found.select("row.*", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_sharding": op9_sharding}
SQL: dict[str, str] = {}
