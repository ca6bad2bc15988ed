"""Mixing sources to target weights by hierarchical budgeting, in DataFrame expressions alone.

A tree of domains, languages and sources gets a budget of tokens. Each node hands its budget to its children by their
weights; a child that holds less than its part (its tokens times ``MAX_EPOCHS``) gives the rest back to its siblings,
and only what a whole family can't hold goes back to its ancestor's other children. Because a node's capacity is the
sum of its leaves', the water level of one family has a closed form over its children sorted by capacity per weight:
three windows over a table with a row for each leaf, none of it on the driver.

A leaf with budget b over t tokens takes every document floor(b / t) times, and then the longest prefix of documents
in the order of the next epoch's seeded md5 whose tokens fit what's left. Prefixes are found digit by digit, so that no
task holds a leaf: tokens are summed by the next ``NIBBLES`` hex digits of the md5, which leaves one bucket of each leaf,
and again inside it until no bucket holds more than ``BUCKET_ROWS`` rows; in these, documents are ranked.

Null domain, language or source count as the value ``''``; a null text has no tokens, and is taken whenever the prefix
reaches it. Repeated rows tie, and are taken together or not at all. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, named, table, words

SEED = 17
MAX_EPOCHS = 2
#: Share of all tokens, in percent, that the mixture is to hold.
BUDGET_PERCENT = 80
NIBBLES = 3
#: Most rows of a leaf that one task ranks; a bucket with more is split by further digits.
BUCKET_ROWS = 200_000
#: Integer target weights; any value that isn't listed weighs DEFAULT_WEIGHT among its siblings.
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 2}
DEFAULT_WEIGHT = 1
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The production tree's upper level: sources by the parity of their number, ``other`` without one."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9])$", 1)
    return F.when(digits == "", "other").when(digits.isin("0", "2", "4", "6", "8"), "even").otherwise("odd")


def weight(level: str, value: Column) -> Column:
    if level != "lang":
        return F.lit(DEFAULT_WEIGHT).cast("long")
    out = F.lit(DEFAULT_WEIGHT)
    for k, v in LANG_WEIGHTS.items():
        out = F.when(value == k, v).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, weigh=weight, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """``leaves`` (levels, tokens) plus ``budget``: whole tokens, at most tokens * max_epochs."""
    out = leaves.withColumn("_budget", F.floor(leaves.agg(F.sum("tokens")).scalar() * percent / 100).cast("long"))
    for depth, level in enumerate(levels):
        up, here = list(levels[:depth]), list(levels[: depth + 1])
        family = Window.partitionBy(*up, "_root").orderBy("_tight", *here)
        nodes = out.groupBy(*here).agg(F.max("_budget").alias("_budget"), (F.sum("tokens") * max_epochs).alias("_cap")).withColumn("_w", weigh(level, F.col(level))).withColumn("_root", F.lit(0)).withColumn("_tight", F.col("_cap") / F.col("_w"))
        before = family.rowsBetween(Window.unboundedPreceding, -1)
        after = family.rowsBetween(0, Window.unboundedFollowing)
        left = F.greatest(F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0)), F.lit(0))
        nodes = nodes.withColumn("_left", left).withColumn("_wsum", F.sum("_w").over(after))
        # Full where its capacity is below its part of what fuller siblings leave; the others share one level.
        nodes = nodes.withColumn("_full", F.col("_cap") * F.col("_wsum") <= F.col("_left") * F.col("_w"))
        free = Window.partitionBy(*up, "_root")
        nodes = nodes.withColumn("_rest", F.max(F.when(~F.col("_full"), F.col("_left"))).over(free)).withColumn("_of", F.max(F.when(~F.col("_full"), F.col("_wsum"))).over(free))
        given = F.when(F.col("_full"), F.col("_cap")).otherwise(F.expr("_rest * _w div _of"))
        out = out.drop("_budget").join(nodes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(here)], given.alias("_budget")), [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(here)]).drop(*[f"_k{i}" for i in range(len(here))])
        out = cut(out)  # a row for each leaf; the next level reads it twice
    return out.withColumnRenamed("_budget", "budget")


def mix(docs: DataFrame, tokens: Column, domain: Column, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weigh=weight, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows of ``docs`` in the mixture, with ``mix_copies``: how many epochs take the row; plus the leaf and its budget.

    ``docs`` needs doc_id, lang and source; its own columns are kept below ``row``. Prefixes are found on narrow rows; the
    rows themselves meet only the small table of leaves.
    """
    keys = [tokens.cast("long").alias("tokens"), domain.alias("domain"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")]
    narrow = cut(docs.select(*keys))
    leaves = budgets(cut(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))), percent, max_epochs, weigh).withColumnRenamed("tokens", "leaf_tokens")
    epochs = F.when(F.col("leaf_tokens") > 0, F.expr("budget div leaf_tokens")).otherwise(F.lit(0)).cast("long")
    leaves = cut(leaves.withColumn("epochs", epochs).withColumn("_rest", F.col("budget") - epochs * F.col("leaf_tokens")))

    def ordered(rows: DataFrame, table: DataFrame) -> DataFrame:
        order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs"), F.col("_id")).cast("binary"))
        return rows.join(table, list(LEVELS)).withColumn("_at", F.struct(order.alias("order"), F.col("_id").alias("id"), F.col("tokens").alias("tokens")))

    head = lambda digits: F.substring("_at.order", 1, digits)
    inside, digits, most = ordered(narrow, leaves.select("*", F.lit(0).cast("long").alias("_before"))), 0, bucket_rows + 1
    while most > bucket_rows and digits < 32:
        # The bucket in which each leaf's prefix ends, and the tokens before it.
        digits = min(digits + NIBBLES, 32)
        sums = inside.groupBy(*LEVELS, head(digits).alias("_end")).agg(F.sum("tokens").alias("_sum"), F.count(F.lit(1)).alias("_rows"), F.first("_rest").alias("_rest"), F.first("_before").alias("_before"))
        run = Window.partitionBy(*LEVELS).orderBy("_end")
        ends = sums.withColumn("_before", F.col("_before") + F.sum("_sum").over(run) - F.col("_sum")).where((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_sum") > F.col("_rest")))
        ends = cut(ends.select(*LEVELS, "_end", "_before", "_rows"))
        most = ends.agg(F.max("_rows")).first()[0] or 0
        inside = ordered(narrow, leaves.join(ends, list(LEVELS))).where(head(digits) == F.col("_end"))
    # The last row in it that still fits; equal rows are one.
    ranked = inside.groupBy(*LEVELS, "_at").agg(F.sum("tokens").alias("_sum"), F.first("_rest").alias("_rest"), F.first("_before").alias("_before"))
    fits = F.col("_before") + F.sum("_sum").over(Window.partitionBy(*LEVELS).orderBy("_at")) <= F.col("_rest")
    last = ranked.withColumn("_fits", fits).where("_fits").groupBy(*LEVELS).agg(F.max("_at").alias("_last"))
    table = cut(leaves.join(ends.drop("_before", "_rows"), list(LEVELS), "left").join(last, list(LEVELS), "left"))
    rows = ordered(docs.select(F.struct(*[named(c).alias(c) for c in docs.columns]).alias("row"), *keys), table)
    more = F.col("_end").isNull() | (head(digits) < F.col("_end")) | ((head(digits) == F.col("_end")) & F.coalesce(F.col("_at") <= F.col("_last"), F.lit(False)))
    return rows.withColumn("mix_copies", F.col("epochs") + more.cast("long")).where("mix_copies > 0").select("row", *LEVELS, "tokens", "budget", "mix_copies")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.size(words(F.col("text"))).cast("long").alias("n"))
    mixed = mix(docs, F.col("n"), domain_of(F.col("source")))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), *LEVELS, F.col("tokens").alias("n_tokens"), "budget", "mix_copies")


def _level_sql(depth: int) -> str:
    here, up = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
    part = f"PARTITION BY {up}" if up else ""
    w = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANG_WEIGHTS.items()) + f" ELSE {DEFAULT_WEIGHT} END" if LEVELS[depth] == "lang" else str(DEFAULT_WEIGHT)
    return f"""
a{depth} AS (SELECT {here}, max(budget) AS b, CAST(sum(tokens) AS BIGINT) * {MAX_EPOCHS} AS cap, {w} AS w FROM l{depth} GROUP BY {here}),
b{depth} AS (SELECT *, greatest(b - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS left_, sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM a{depth} WINDOW f AS ({part} ORDER BY cap / w, {here})),
c{depth} AS (SELECT *, cap * ws <= left_ * w AS full_ FROM b{depth}),
d{depth} AS (SELECT *, max(CASE WHEN NOT full_ THEN left_ END) OVER g AS rest, max(CASE WHEN NOT full_ THEN ws END) OVER g AS of_ FROM c{depth} WINDOW g AS ({part})),
l{depth + 1} AS (SELECT l{depth}.* EXCLUDE (budget), CAST(CASE WHEN full_ THEN cap ELSE rest * w // of_ END AS BIGINT) AS budget
  FROM l{depth} JOIN d{depth} USING ({here}))"""


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CASE WHEN regexp_extract(coalesce(source, ''), '([0-9])$', 1) = '' THEN 'other' WHEN regexp_extract(source, '([0-9])$', 1) IN ('0','2','4','6','8') THEN 'even' ELSE 'odd' END AS domain,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
l0 AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(floor(sum(sum(tokens)) OVER () * {BUDGET_PERCENT} / 100) AS BIGINT) AS budget FROM d GROUP BY ALL),
{",".join(_level_sql(k) for k in range(len(LEVELS)))},
e AS (SELECT * EXCLUDE (tokens), tokens AS lt, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS ep FROM l{len(LEVELS)}),
s AS (SELECT doc_id, domain, lang, source, d.tokens AS n_tokens, budget, ep, budget - ep * lt AS rest,
  sum(d.tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || ep || ':' || doc_id), CAST(doc_id AS VARCHAR), d.tokens) AS run
  FROM d JOIN e USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, budget, CAST(ep + (run <= rest)::INT AS BIGINT) AS mix_copies FROM s WHERE ep + (run <= rest)::INT > 0
"""

QUERIES = {"op4_mixing": op4_mixing}
SQL = {"op4_mixing": OP4_SQL}
