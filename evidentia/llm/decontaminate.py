"""Benchmark decontamination by spaced-seed hashing, in DataFrame expressions alone.

A mask keeps some positions of a window of words and ignores the rest, so a window still hashes alike after
words at ignored positions were substituted. Masked windows of benchmark items and of documents are joined on
their hash (a mask's number is part of it); around each hit the words of both sides are compared one by one on the hit's diagonal, and the overlap
counts when at least ``MATCH_PERCENT`` of ``CONTEXT`` aligned words are equal (of all aligned words where the item or the
document has fewer there, but not below ``SPAN``, or the whole item if it is shorter). Every overlap that counts is hit:
see ``MASKS``. Words are lower-cased (A-Z) and lose punctuation at either end.

Documents' windows are made, hashed and looked up in one pass where the documents lie, however large the benchmark is. The benchmark's
side is broadcast while it has ``BLOCK_HASHES`` rows at most (counted; a row has ``REACH`` words at most). Beyond that a bit map of its
hashes is broadcast, of a size that doesn't grow, and the windows that pass it meet the benchmark's rows in a shuffle, where hashes
with many rows on either side are split into a grid. Each document that says what many items say is given with each of them.

Items of fewer than ``SPAN`` words are matched as a whole, by lighter masks if they have ``MIN_TOLERANT`` words, and word for
word if they have fewer: every document that says a one-word item holds it. Null and empty texts match nothing. Rows of one id
are one document; repeated items give their own results; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, let, lower_ascii, numbered, table, unused, words

SPAN = 12
#: Kept positions of each mask, fixed so that both sides hash alike. Of 12 or 13 aligned words two may differ. Four blocks of
#: three words hold two blocks without a difference, side by side, one or two blocks apart: one of the first three masks hits.
#: Of 10 or 11 words two may differ, of 8 or 9 one: among five blocks of two words, three without a difference hold two that
#: are side by side or one block apart, and 8 words with one difference hold a run of four: one of the last two hits.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 6, 7, 8), (0, 1, 2, 9, 10, 11), (0, 1, 2, 3), (0, 1, 4, 5))
LONG, SHORT = (0, 1, 2), (3, 4)  # masks of items of SPAN words or more, and of fewer
MIN_TOLERANT = 8
#: The masks of items of 1 to MIN_TOLERANT - 1 words keep every word; mask len(MASKS) + n - 1 is that of n words.
WHOLE = tuple(tuple(range(n)) for n in range(1, MIN_TOLERANT))
CONTEXT = 13
MATCH_PERCENT = 80
#: Words around a hit that are compared, and rows of the benchmark that are broadcast at most.
REACH = 3 * CONTEXT
BLOCK_HASHES = 50_000
#: Rows of one hash that a task of the shuffled join holds of either side, and bits of a hash that choose a row of the sieve.
HOT_ROWS, SIEVE = 20_000, 20
TRIM = ".,;:!?\"'()"


def hashed_words(text: Column) -> Column:
    """64-bit hashes of a text's words."""
    bare = F.transform(words(lower_ascii(text)), lambda w: F.btrim(w, F.lit(TRIM)))
    return F.transform(F.array_remove(bare, ""), lambda w: F.xxhash64(w))


def _seed(m: int) -> Column:
    """Hash of mask ``m`` over the window of ``w`` that starts at ``p``; null where it doesn't fit."""
    kept = (*MASKS, *WHOLE)[m]
    return F.when(F.col("p") + kept[-1] < F.size("w"), F.xxhash64(F.lit(m), *[F.get("w", F.col("p") + k) for k in kept]))


def _windows(rows: DataFrame, masks: list[int], *columns: str) -> DataFrame:
    """``columns``, w, p and hash of every window of ``rows``' words ``w``. Both explodes and all hashes are compiled together, so ``w`` isn't copied."""
    at = rows.select(*columns, "w", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))).alias("p"))
    return at.select(*columns, "w", "p", F.explode(F.array(*map(_seed, masks))).alias("hash")).where("hash IS NOT NULL")


def _around(at: str) -> tuple[Column, Column]:
    """Where the ``REACH`` words around ``at`` start, and those words."""
    start = F.greatest(F.col(at) - CONTEXT, F.lit(0))
    return start, F.slice("w", start + 1, REACH)


def item_hashes(items: DataFrame, item: str = "item_id", text: str = "text") -> tuple[DataFrame, list[int]]:
    """(hash, item, q, iw): masked windows of every item, with the words around each; and the masks in use."""
    b = cut(items.select(F.col(item).alias("item"), hashed_words(F.col(text)).alias("w")))
    size = F.size("w")
    longs, shorts = b.agg(F.count_if(size >= SPAN), F.count_if((size >= MIN_TOLERANT) & (size < SPAN))).first()
    lengths = [r[0] for r in b.where((size > 0) & (size < MIN_TOLERANT)).select(size).distinct().collect()]  # MIN_TOLERANT - 1 at most
    kinds = [(size >= SPAN, LONG if longs else ()), ((size >= MIN_TOLERANT) & (size < SPAN), SHORT if shorts else ()), *[(size == n, (len(MASKS) + n - 1,)) for n in sorted(lengths)]]
    start, words_there = _around("p")
    found = [_windows(b.where(which), list(masks), "item").select("hash", "item", (F.col("p") - start).alias("q"), words_there.alias("iw")) for which, masks in kinds if masks]
    if not found:
        return b.select(F.lit(0).cast("long").alias("hash"), "item", F.lit(0).alias("q"), F.col("w").alias("iw")).where(F.lit(False)), []
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return cut(out), sorted(m for _, masks in kinds for m in masks)


def _overlap(hit: Column) -> Column:
    """(equal, aligned) words on the diagonal, in the CONTEXT-word window around the hit that holds the most equal ones."""
    dw, iw, p, q = hit["dw"], hit["iw"], hit["p"], hit["q"]
    back = F.least(p, q)
    ahead = F.least(F.size(dw) - p, F.size(iw) - q)
    same = F.transform(F.sequence(F.lit(0), back + ahead - 1), lambda k: (F.get(dw, p - back + k) == F.get(iw, q - back + k)).cast("int"))

    def best(s: Column) -> Column:
        wide = F.least(F.size(s), F.lit(CONTEXT))
        sums = F.transform(F.sequence(F.lit(1), F.size(s) - wide + 1), lambda i: F.aggregate(F.slice(s, i, wide), F.lit(0), lambda a, x: a + x))
        return F.struct(F.array_max(sums).alias("equal"), wide.alias("aligned"))

    return let(same, best)


def _verified(pairs: DataFrame) -> DataFrame:
    """(doc, item, o) of the hits (doc, item, dw, iw, p, q) whose overlap counts."""
    # Exploded, not filtered: a filter would move into the join, which then wouldn't be compiled together with the windows.
    counts = lambda o: (o["aligned"] >= F.least(F.lit(SPAN), F.size("iw"))) & (100 * o["equal"] >= MATCH_PERCENT * o["aligned"])
    return pairs.select("doc", "item", F.explode(F.filter(F.array(_overlap(F.struct("dw", "iw", "p", "q"))), counts)).alias("o"))


def _sieved(windows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The windows whose hash may be one of ``hashes``: none that is gets lost. What is broadcast is a bit map of ``1 << SIEVE``
    rows of 64 bits at most, however large the benchmark is."""
    place, bit = F.shiftrightunsigned("hash", 64 - SIEVE), F.shiftrightunsigned("hash", 58 - SIEVE).bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = cut(hashes.select(place.alias("place"), one.alias("one")).groupBy("place").agg(F.bit_or("one").alias("bits")))
    return windows.withColumn("place", place).join(F.broadcast(bits), "place").where(F.bit_get("bits", bit) == 1).drop("place", "bits")


def _dealt(seen: DataFrame, hashes: DataFrame, hot_rows: int) -> DataFrame:
    """``seen`` joined with ``hashes`` by a shuffle. A hash with more than ``hot_rows`` rows on a side becomes a grid: each side is
    dealt over its own parts and repeated along the other's, so each pair meets once and no task holds a hash's rows."""
    seen = numbered(seen, "n")
    rows_of = lambda t, name: t.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / hot_rows).cast("int").alias(name))
    grid = cut(rows_of(hashes, "down").join(rows_of(seen, "across"), "hash").where("down > 1 OR across > 1"))
    grid = F.broadcast(grid) if grid.count() <= BLOCK_HASHES else grid.hint("merge")

    def placed(t: DataFrame, mine: str, other: str, by: Column) -> DataFrame:
        own = F.pmod(by, F.coalesce(mine, F.lit(1))).cast("int")
        along = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return t.join(grid, "hash", "left").withColumn(f"{mine}_at", own).withColumn(f"{other}_at", along).drop("down", "across")

    left, right = placed(seen, "across", "down", F.xxhash64("n")), placed(hashes, "down", "across", F.xxhash64("item", "q", "iw"))
    return left.hint("shuffle_hash").join(right, ["hash", "down_at", "across_at"])


def matches(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", block_hashes: int = BLOCK_HASHES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc, item_id, hits, equal, aligned): documents with the benchmark items that they hold, and the best overlap."""
    hashes, masks = item_hashes(items)
    windows = _windows(docs.select(F.col(doc).alias("doc"), hashed_words(F.col(text)).alias("w")), masks or [0], "doc")
    start, words_there = _around("p")
    around = [(F.col("p") - start).alias("p"), words_there.alias("dw")]
    if hashes.count() <= block_hashes:
        found = _verified(windows.join(F.broadcast(hashes), "hash").select("doc", "item", "q", "iw", *around))
    else:
        found = _verified(_dealt(_sieved(windows, hashes).select("doc", "hash", *around), hashes, hot_rows))
    best = F.max(F.struct("o.equal", "o.aligned"))
    return found.groupBy("doc", F.col("item").alias("item_id")).agg(F.count(F.lit(1)).alias("hits"), best.alias("o")).select("doc", "item_id", "hits", "o.equal", "o.aligned")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that hold no benchmark passage, decided by their text, as ids may be null or repeat.

    Other columns may have any names."""
    said = F.sha2(F.col(text).cast("binary"), 256)
    name = unused("said", docs.columns)
    bad = matches(docs.select(said.alias("said"), F.col(text).alias("text")), items, "said").select(F.col("doc").alias(name)).distinct()
    return docs.join(bad, said == F.col(name), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("doc", "doc_id")


def _sql() -> str:
    quoted = TRIM.replace("'", "''")
    said = lambda t, key: rf"SELECT {key}, list_filter(list_transform(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), lambda x: trim(x, '{quoted}')), lambda x: x <> '') AS w FROM {t}"
    rule = {m: f"len(w) >= {SPAN}" for m in LONG} | {m: f"len(w) BETWEEN {MIN_TOLERANT} AND {SPAN - 1}" for m in SHORT} | {len(MASKS) + k: f"len(w) = {k + 1}" for k in range(len(WHOLE))}

    def windows(t: str, key: str, which: bool) -> str:
        return " UNION ALL ".join(f"SELECT {key}, {m} AS mask, p, concat_ws(' ', {', '.join(f'w[p + {k + 1}]' for k in kept)}) AS seed FROM (SELECT {key}, w, unnest(range(0, len(w) - {kept[-1]})) AS p FROM {t} WHERE len(w) > {kept[-1]}{f' AND {rule[m]}' if which else ''})" for m, kept in enumerate((*MASKS, *WHOLE)))

    return f"""
WITH d AS ({said('documents', 'doc_id')}), i AS ({said('benchmark', 'item_id')}),
dh AS ({windows('d', 'doc_id', False)}), ih AS ({windows('i', 'item_id', True)}),
h AS (SELECT doc_id, item_id, mask, dh.p AS p, ih.p AS q FROM dh JOIN ih USING (mask, seed)),
a AS (SELECT h.doc_id, h.item_id, d.w[greatest(p - {CONTEXT}, 0) + 1 : greatest(p - {CONTEXT}, 0) + {REACH}] AS dw, i.w[greatest(q - {CONTEXT}, 0) + 1 : greatest(q - {CONTEXT}, 0) + {REACH}] AS iw,
  least(p, {CONTEXT}) AS p, least(q, {CONTEXT}) AS q FROM h JOIN d ON h.doc_id = d.doc_id JOIN i ON h.item_id = i.item_id),
s AS (SELECT doc_id, item_id, len(iw) AS words, list_transform(range(0, least(p, q) + least(len(dw) - p, len(iw) - q)), lambda k: (dw[p - least(p, q) + k + 1] = iw[q - least(p, q) + k + 1])::INT) AS same FROM a),
o AS (SELECT doc_id, item_id, words, least(len(same), {CONTEXT}) AS aligned, list_max(list_transform(range(1, len(same) - least(len(same), {CONTEXT}) + 2), lambda k: list_sum(same[k : k + least(len(same), {CONTEXT}) - 1]))) AS equal FROM s)
SELECT doc_id, item_id, count(*) AS hits, CAST(max(equal * 100 + aligned) // 100 AS INTEGER) AS equal, CAST(max(equal * 100 + aligned) % 100 AS INTEGER) AS aligned
FROM o WHERE aligned >= least({SPAN}, words) AND 100 * equal >= {MATCH_PERCENT} * aligned GROUP BY ALL
"""


#: The same seeds, overlaps and rule in SQL, on words instead of hashes.
OP5_SQL = _sql()

QUERIES = {"op5_decontamination": op5_decontamination}
SQL = {"op5_decontamination": OP5_SQL}
