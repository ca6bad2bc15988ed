"""Fill-in-middle transformation on ropes.

A text becomes a rope: a balanced tree whose leaves hold runs of whole units and cache how many units and code points they
have, and whose nodes cache the sums. The rope is split at two unit ranks, which costs the tree's depth and one leaf each,
and the subtrees are joined again in another order with sentinels between them; no text is copied until the leaves are
written out. The inverse reads the output as a rope, finds the sentinels, splits there and joins the parts in their order.

A unit is what the pattern ``unit`` matches next, left to right, and whatever lies between two matches is a unit too, so
that units tile the text; without a pattern a unit is a code point. Both ranks come from a digest of the seed and the
row's key, so a row's result doesn't depend on other rows, partitions or retries.

A text that is null or empty, or holds a sentinel, stays plain, as does the share that is not rewritten. A null key counts as
the empty string; repeated rows get equal results. Very long texts are one rope, of leaves of ``LEAF`` units. An empty table
gives an empty table. Other columns ride along, whatever their names; columns named as the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Percent of texts that are rewritten, and percent of those that put the suffix first.
RATE, SPM = 90, 20
LEAF = 4096
BATCH_CHARS = 4_000_000
COLUMNS = {"fim_text": "string", "fim_form": "string", "fim_units": "long", "fim_prefix_chars": "long", "fim_middle_chars": "long"}


class Leaf(NamedTuple):
    text: str
    units: int
    points: int
    #: Ends of the units in code points; None where each code point is one.
    ends: tuple[int, ...] | None = None


class Node(NamedTuple):
    left: Rope
    right: Rope
    units: int
    points: int


Rope = Leaf | Node
EMPTY = Leaf("", 0, 0)


def join(a: Rope, b: Rope) -> Rope:
    if not a.points or not b.points:
        return a if a.points else b
    return Node(a, b, a.units + b.units, a.points + b.points)


def _balanced(leaves: list[Leaf]) -> Rope:
    while len(leaves) > 1:
        leaves = [join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def rope(text: str, unit: re.Pattern | None = None, leaf: int = LEAF) -> Rope:
    if unit is None:
        return _balanced([Leaf(t, len(t), len(t)) for i in range(0, len(text), leaf) for t in (text[i : i + leaf],)])
    ends = [0]
    for m in unit.finditer(text):
        ends += [e for e in (m.start(), m.end()) if e > ends[-1]]
    ends += [len(text)] * (ends[-1] < len(text))
    out = []
    for i in range(0, len(ends) - 1, leaf):
        part = ends[i : i + leaf + 1]
        out.append(Leaf(text[part[0] : part[-1]], len(part) - 1, part[-1] - part[0], tuple(e - part[0] for e in part[1:])))
    return _balanced(out)


def split(r: Rope, rank: int, points: bool = False) -> tuple[Rope, Rope]:
    """The first ``rank`` units, or code points, and the rest. A leaf that is cut by code points has code points for units."""
    size = r.points if points else r.units
    if rank <= 0 or rank >= size:
        return (EMPTY, r) if rank <= 0 else (r, EMPTY)
    if isinstance(r, Node):
        left = r.left.points if points else r.left.units
        if rank < left:
            a, b = split(r.left, rank, points)
            return a, join(b, r.right)
        a, b = split(r.right, rank - left, points)
        return join(r.left, a), b
    if points or r.ends is None:
        return Leaf(r.text[:rank], rank, rank), Leaf(r.text[rank:], r.points - rank, r.points - rank)
    at = r.ends[rank - 1]
    return Leaf(r.text[:at], rank, at, r.ends[:rank]), Leaf(r.text[at:], r.units - rank, r.points - at, tuple(e - at for e in r.ends[rank:]))


def leaves(r: Rope) -> Iterator[str]:
    stack = [r]
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            stack += (x.right, x.left)
        else:
            yield x.text


def written(r: Rope) -> str:
    return "".join(leaves(r))


def find(r: Rope, mark: str) -> int:
    """Code points before the first ``mark``; it may lie across leaves."""
    at, tail = 0, ""
    for text in leaves(r):
        if (hit := (tail + text).find(mark)) >= 0:
            return at - len(tail) + hit
        at, tail = at + len(text), (tail + text)[-(len(mark) - 1) :]
    raise ValueError(f"no {mark}")


def draws(key: str, seed: int = SEED) -> tuple[int, int, int, int]:
    said = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(said[i : i + 8], 16) for i in (0, 8, 16, 24))


def rearrange(text: str, key: str, unit: re.Pattern | None = None, seed: int = SEED, rate: int = RATE, spm: int = SPM, leaf: int = LEAF) -> tuple[str, str, int, int | None, int | None]:
    """(output, form, units, code points of the prefix, of the middle)."""
    whole = rope(text, unit, leaf)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return text, "plain", whole.units, None, None
    first, last = sorted((h1 % (whole.units + 1), h2 % (whole.units + 1)))
    head, suffix = split(whole, last)
    prefix, middle = split(head, first)
    p, s, m = (Leaf(mark, 1, len(mark)) for mark in (PREFIX, SUFFIX, MIDDLE))
    form, parts = ("spm", (s, suffix, p, prefix, m, middle)) if h4 % 100 < spm else ("psm", (p, prefix, s, suffix, m, middle))
    return written(reduce(join, parts)), form, whole.units, prefix.points, middle.points


def restore(output: str, form: str, leaf: int = LEAF) -> str:
    """The text that was rearranged to ``output``."""
    if form == "plain":
        return output
    rest, parts = rope(output, leaf=leaf), []
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    for mark, until in zip(order, (*order[1:], None)):
        _, rest = split(rest, len(mark), points=True)
        part, rest = split(rest, find(rest, until), points=True) if until else (rest, EMPTY)
        parts.append(part)
    if form == "spm":
        parts[0], parts[1] = parts[1], parts[0]
    prefix, suffix, middle = parts
    return written(join(join(prefix, middle), suffix))


def _added(df: DataFrame, new: dict[str, str], run, *read: Column) -> DataFrame:
    """``df`` plus columns ``new``: ``run`` gets the values of ``read`` of a row and returns theirs."""
    keep = [c for c in df.columns if c.lower() not in new]
    ins = [c.alias(f"_{i}") for i, c in enumerate(read)]
    types = [pa.int64() if t == "long" else pa.string() for t in new.values()]
    kept = df.select(F.struct(*[named(c).alias(c) for c in keep]).alias("kept"), *ins)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out, begun, chars = [], 0, 0
            for i, values in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]])):
                out.append(run(*values))
                chars += sum(len(v) for v in out[-1] if isinstance(v, str))
                if chars > BATCH_CHARS or i + 1 == batch.num_rows:
                    made = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begun, len(out)), *made], ["kept", *new])
                    out, begun, chars = [], i + 1, 0

    schema = T.StructType([kept.schema["kept"], *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in new.items()))])
    return kept.mapInArrow(batches, schema).select("kept.*", *new)


def fill_in_middle(df: DataFrame, text: str = "text", key: str = "doc_id", unit: str | None = None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``df`` plus the rearranged text, its form (plain, psm, spm), the units of the text, and the code points of prefix and middle."""
    pattern = re.compile(unit) if unit else None
    id_text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    return _added(df, COLUMNS, lambda t, k: rearrange(t or "", k, pattern, seed, rate, spm), F.col(f"`{text}`"), id_text)


def restored(df: DataFrame) -> DataFrame:
    """``df`` (with fim_text and fim_form) plus ``fim_restored``, rebuilt from these two alone."""
    return _added(df, {"fim_restored": "string"}, lambda t, form: (restore(t, form),), F.col("fim_text"), F.col("fim_form"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle(docs).drop("text")
    digest = made.withColumn("output_sha256", F.sha2("fim_text", 256))
    sha = F.sha2("fim_restored", 256).alias("restored_sha256")
    return restored(digest).select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"), "output_sha256", sha)


_DRAWS = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
SQL = {
    "op13_fill_in_middle": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
             sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, {_DRAWS} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
             WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
         ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM g"""
}
