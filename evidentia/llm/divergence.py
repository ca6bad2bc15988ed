"""Source divergence audit: how far each source of a language strays from its fellows, term by term and pair by pair.

Each language keeps the terms of at least ``MIN_DOCS`` of its documents. A group (language, source), and the language as a
whole, gives each kept term a share p = 1 + floor(SCALE * (count + 1) / (N + V)), and a share p differs from q by
f = floor((p - q)^2 / q). Part ``pair`` sums f over all kept terms for each ordered pair of sources; part ``term`` lists
the terms that a group uses more than its language does. All arithmetic is on integers.

The sums of pairs split terms in two. *Heavy* terms, in more than ``HEAVY`` of a language's groups, fill dense tiles (terms x
groups) of numpy, of which f is taken for all pairs at once. *Light* terms are absent from most groups, where their share is
the group's own least share z. So each light term starts as f(z_g, z_h) for all pairs, a number of the groups alone;
each posting (term, g) corrects the pairs of g with every h by f(p, z_h) - f(z_g, z_h), and equal p of a group are
corrected together; each pair of postings of one term corrects that pair by what is left. The two partial sums are
added; no rounding enters, so the split changes nothing but the work.

Work is dealt by (language, two blocks of ``BLOCK`` groups, a salt of the term), where a salt holds some ``TERMS`` terms, so
no task grows with the vocabulary or with the square of the sources. Texts are counted where they lie: a task hands on
one row for each (language, source, term) of ``HELD`` words at most, so a source with a third of all rows is no hot key.

Null text, lang and source are ''. A document is a row, so repeated rows count again. Ties in rank are broken by the item's
UTF-8 bytes. An empty table gives no rows; a language without kept terms gives pairs of value 0. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Terms in more than this share of a language's groups are heavy.
HEAVY = 0.25
BLOCK, TERMS = 256, 16_384
#: Different (language, source, term) that a task holds before it hands its counts on.
HELD = 400_000
#: Products that a dense tile takes at once.
TILE = 1 << 22
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the texts, summed as far as memory allows; the term '' counts documents."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            names = list(docs)
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(part), "source": [source] * len(part), "term": part, "n": [n[t] for t in part], "docs": [docs[t] for t in part]})
        held.clear()

    for batch in batches:
        for text, lang, source in zip(*[c.to_pylist() for c in batch.columns]):
            n, docs = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
            found = Counter(TERM.findall((text or "").translate(_LOWER)))
            n.update(found)
            docs.update(found.keys())
            docs[""] += 1
        if sum(len(d) for _, d in held.values()) > HELD:
            yield from out()
    yield from out()


def share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 1) / total), in decimals, which a product doesn't overflow; ``total`` 0 only without terms."""
    return F.expr(f"1L + (CAST({count} + 1 AS DECIMAL(20,0)) * {SCALE}) div CAST(greatest({total}, 1L) AS DECIMAL(20,0))")


def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def tile_sums(table: pa.Table) -> pa.Table:
    """Partial sums of f for the pairs of a tile's groups; V * f(z_g, z_h), from which corrections start, is in salt 0."""
    kind, gid, p = (table[c].to_numpy() for c in ("kind", "gid", "p"))
    own = np.flatnonzero(kind == 0)
    own = own[np.argsort(gid[own])]
    ids, z = gid[own], p[own]
    base = far(z[:, None], z[None, :])
    salt, x, y = (table[c][0].as_py() for c in ("salt", "x", "y"))
    sums = base * table["terms"].to_numpy()[own[0]] if salt == 0 else np.zeros_like(base)
    rows = np.flatnonzero(kind > 0)
    term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[rows]
    rows = rows[np.argsort(term, kind="stable")]
    at, p, kind, term = np.searchsorted(ids, gid[rows]), p[rows], kind[rows], np.sort(term)
    _dense(sums, base, z, at[kind == 2], p[kind == 2], term[kind == 2])
    _sparse(sums, base, z, at[kind == 1], p[kind == 1], term[kind == 1])
    g, h = np.indices(sums.shape).reshape(2, -1)
    block = ids // BLOCK
    wanted = (g != h) & ((x == y) | (block[g] != block[h]))
    g, h = g[wanted], h[wanted]
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(g), pa.string()), "g": ids[g], "h": ids[h], "value": sums[g, h]})


def _dense(sums: np.ndarray, base: np.ndarray, z: np.ndarray, at: np.ndarray, p: np.ndarray, term: np.ndarray) -> None:
    """Heavy terms: shares of all groups side by side, f of all pairs at once."""
    if not len(term):
        return
    number = np.cumsum(np.r_[0, term[1:] != term[:-1]])
    dense = np.broadcast_to(z, (number[-1] + 1, len(z))).copy()
    dense[number, at] = p
    step = max(1, TILE // base.size)
    for i in range(0, len(dense), step):
        part = dense[i : i + step]
        sums += far(part[:, :, None], part[:, None, :]).sum(0) - len(part) * base


def _sparse(sums: np.ndarray, base: np.ndarray, z: np.ndarray, at: np.ndarray, p: np.ndarray, term: np.ndarray) -> None:
    """Light terms: corrections of each posting against all groups, then of each pair of a term's postings."""
    if not len(term):
        return
    order = np.lexsort((p, at))
    a, b = at[order], p[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    many = np.diff(np.r_[first, len(a)])
    step = max(1, TILE // len(z))
    for i in range(0, len(first), step):
        g, q, n = a[first[i : i + step]], b[first[i : i + step], None], many[i : i + step, None]
        np.add.at(sums, g, n * (far(q, z) - base[g]))
        np.add.at(sums.T, g, n * (far(z, q) - base.T[g]))
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    sizes = np.diff(np.r_[starts, len(term)])
    for k in np.unique(sizes[sizes > 1]):
        run = starts[sizes == k]
        step = max(1, TILE // (k * k))
        for i in range(0, len(run), step):
            rows = run[i : i + step, None] + np.arange(k)
            g, h = at[rows][:, :, None], at[rows][:, None, :]
            pg, ph = p[rows][:, :, None], p[rows][:, None, :]
            np.add.at(sums, (g, h), far(pg, ph) - far(pg, z[h]) - far(z[g], ph) + base[g, h])


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of a group; the term '' has the group's documents."""
    read = docs.select(*[F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate((text, lang, source))])
    parts = read.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, heavy: float = HEAVY) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of both parts, as the module's text says."""
    found = cut(counted(docs, text, lang, source))
    same = Window.partitionBy("lang", "term")
    spread = {"everywhere": F.sum("n").over(same), "held": F.sum("docs").over(same), "groups": F.count(F.lit(1)).over(same), "first": F.min("source").over(same) == F.col("source")}
    kept = cut(found.where("term <> ''").withColumns(spread).where(F.col("held") >= min_docs).select("lang", "source", "term", "n", "everywhere", "groups", "first"))
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum(F.col("first").cast("long")).alias("terms"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    every = Window.partitionBy("lang")
    named = found.where("term = ''").join(by_lang, "lang", "left").join(by_group, ["lang", "source"], "left").na.fill(0, ["all_n", "terms", "own_n"])
    ranks = {"gid": F.row_number().over(every.orderBy("source")).cast("long") - 1, "width": F.count(F.lit(1)).over(every)}
    groups = cut(named.select("lang", "source", "own_n", "all_n", "terms", share("0", "own_n + terms").alias("z")).withColumns(ranks))
    held = kept.join(groups, ["lang", "source"]).withColumns({"p": share("n", "own_n + terms"), "q": share("everywhere", "all_n + terms")})
    out = _pairs(held, groups, heavy).unionByName(_terms(held, top))
    return out.select("lang", "source", "part", "item", "value", "rank")


def _ranked() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))


def _terms(held: DataFrame, top: int) -> DataFrame:
    over = held.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    return over.withColumn("rank", _ranked()).where(F.col("rank") <= top)


def _pairs(held: DataFrame, groups: DataFrame, heavy: float) -> DataFrame:
    salts = F.expr(f"terms div {TERMS}L")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(width - 1) div {BLOCK}L")))
    tile = [F.least("_b", "_o").alias("x"), F.greatest("_b", "_o").alias("y")]

    def dealt(df: DataFrame, salt: Column, kind: Column, term: Column, p: str) -> DataFrame:
        df = df.withColumns({"_b": F.expr(f"gid div {BLOCK}L"), "_o": blocks}).withColumn("salt", salt)
        return df.select("lang", *tile, "salt", kind.cast("int").alias("kind"), term.alias("term"), "gid", F.col(p).alias("p"), "terms")

    seeds = dealt(groups, F.explode(F.sequence(F.lit(0).cast("long"), salts)), F.lit(0), F.lit(""), "z")
    postings = dealt(held, F.pmod(F.xxhash64("term"), salts + 1), F.when(F.col("groups") > heavy * F.col("width"), 2).otherwise(1), F.col("term"), "p")
    sums = seeds.unionByName(postings).groupBy("lang", "x", "y", "salt").applyInArrow(tile_sums, "lang string, g long, h long, value long")
    sums = sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    names = lambda gid, name: groups.select("lang", F.col("gid").alias(gid), F.col("source").alias(name))
    pairs = sums.join(names("g", "source"), ["lang", "g"]).join(names("h", "item"), ["lang", "h"])
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", _ranked())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


_F = "(p - q) * (p - q) // q"
QUERIES = {"op11_source_divergence": op11_source_divergence}
SQL = {
    "op11_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
o AS (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM o GROUP BY ALL HAVING count(DISTINCT id) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS terms, sum(n) AS n FROM kept GROUP BY lang),
gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
s AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + {SCALE} * (coalesce(c.n, 0) + 1) // (coalesce(gn.n, 0) + v.terms) AS p, 1 + {SCALE} * (kept.n + 1) // (v.n + v.terms) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c USING (lang, source, term)),
r AS (SELECT lang, source, 'term' AS part, term AS item, {_F} AS value FROM s WHERE n > 0 AND p > q
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, coalesce(x.value, 0)
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT lang, source, item, sum({_F}) AS value
    FROM (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source)
    GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= {TOP}"""
}
