import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import decontaminate, mixing, quality, sharding
from tests.llm.helpers import DOCS, empty_docs, odd_docs, prose, save

SF = "/root/testdata/sf0.001"


def brute_repeats(ws):
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    n, hit = Counter(wins), set()
    for i, w in enumerate(wins):
        if n[w] > 1:
            hit |= set(range(i, i + 8))
    return len(hit)


def test_quality_counts(spark, tmp_path):
    loop = " ".join("abcdefghij") + " "
    docs = odd_docs(spark).union(spark.createDataFrame([(20, loop * 9 + "z", "en", "s", 1, None, None), (21, "same line\nother\nsame line\n \n ", "en", "s", 1, None, None)], DOCS))
    got = quality.op7_quality_rules(spark, save(docs, tmp_path, "documents")).collect()
    texts = Counter()
    for r in docs.collect():
        ws = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        texts[(r.doc_id, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), brute_repeats(ws))] += 1
    assert texts == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert not any(r.kept for r in got if r.n_words < 20 or r.doc_id == 20) and any(r.kept for r in got)


def test_quality_order_changes_no_verdict(spark):
    docs = odd_docs(spark).withColumn("_q", F.lit(1)).withColumn("rejected_by", F.lit("x"))
    names = quality.cascade(docs)
    kept = lambda order: sorted(str(r.doc_id) for r in docs.where(~quality.judge(F.col("text"), order)).select("doc_id").collect())
    assert kept(names) == kept(names[::-1]) == sorted(str(r.doc_id) for r in quality.accepted(docs).collect()) != []
    assert quality.accepted(docs).columns == docs.columns and quality.accepted(empty_docs(spark)).columns == empty_docs(spark).columns
    ticks = iter(range(100))
    rs = quality.production(F.col("q"))
    assert len(quality.ordered(docs.select(quality.measured(F.col("text")).alias("q")), rs, clock=lambda: next(ticks))) == len(rs)


@pytest.mark.parametrize("shards", [3, 24])
def test_shards_are_even_and_gapless(spark, shards):
    hot = [(i, "the same text", "en", "s", 1, None, None) for i in range(900)]
    docs = odd_docs(spark).where("doc_id IS NULL OR doc_id <> 6").union(spark.createDataFrame(hot + [(1000 + i, prose(30, i), "en", "s", 1, None, None) for i in range(900)], DOCS))
    got = sharding.shard(docs, shards).collect()
    assert len(got) == docs.count()
    size, slots = Counter(), {}
    for r in got:
        size[r.shard] += len((r.text or "").encode()) + 8
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / shards
    assert set(size) == set(range(shards)) and max(abs(v - mean) for v in size.values()) < 2500
    assert sharding.shard(empty_docs(spark), shards).count() == 0


def test_cells_change_no_slot(spark, tmp_path):
    """Cells of any size give the order by (hash, id), as sorting all rows by hand does; columns named like the operator's own stay."""
    docs = odd_docs(spark).union(spark.createDataFrame([(i, "one text" if i % 3 else prose(30, i), "en", "s", 1, None, None) for i in range(2000, 2600)], DOCS))
    docs = docs.withColumn("_h", F.lit("mine")).withColumn("_c", F.lit("too"))
    said = lambda df: Counter((r.doc_id, r.text, r.shard, r.slot, r._h, r._c) for r in df.collect())
    whole = said(sharding.shard(docs, 5))
    assert whole == said(sharding.shard(docs, 5, cell_bytes=300)) == said(sharding.shard(docs, 5, cell_bytes=5000))
    keys = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    ranked = sorted(keys, key=lambda r: (r.h, -(1 << 63) if r.doc_id is None else r.doc_id))
    assert [(d, t) for d, t, *_ in sorted(whole.elements(), key=lambda x: (x[2], x[3]))] == [(r.doc_id, r.text) for r in ranked]


def test_op9_query(spark, tmp_path):
    docs = odd_docs(spark).union(spark.createDataFrame([(3000 + i, prose(30, i), "en", "s", 1, None, None) for i in range(400)], DOCS))
    got = sharding.op9_sharding(spark, save(docs, tmp_path, "documents")).collect()
    sizes = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sizes == Counter((r.doc_id, r["size"], r.text_crc32) for r in got)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and {r.shard for r in got} <= set(range(24))
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(24))


def test_budget_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 1000), ("b", "x", "1", 2000)], "domain string, lang string, source string, tokens long")
    even = lambda level, value: F.lit(1).cast("long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, 50, 1, even).collect()}
    # 2005 in all: 1002 each domain, 501 each language, and what source 1 can't hold goes to source 2 beside it.
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 491, ("a", "y", "1"): 501, ("b", "x", "1"): 1002}


def test_mixture_stays_in_budget(spark):
    docs = odd_docs(spark).withColumn("n", F.lit(7).cast("long"))
    got = mixing.mix(docs, F.col("n"), mixing.domain_of(F.col("source")))
    for r in got.groupBy("domain", "lang", "source").agg(F.sum(F.col("tokens") * F.col("mix_copies")).alias("used"), F.max("budget").alias("budget")).collect():
        assert r.used <= r.budget
    assert mixing.mix(empty_docs(spark), F.lit(1), mixing.domain_of(F.col("source"))).count() == 0


def test_mixture_prefix_is_the_same_by_any_digits(spark):
    docs = spark.range(3000).selectExpr("id div 2 AS doc_id", "if(id % 3 = 0, 'en', 'de') AS lang", "concat('src', id % 2) AS source", "id % 7 AS n")
    mixed = lambda rows: Counter(map(tuple, mixing.mix(docs, F.col("n"), mixing.domain_of(F.col("source")), bucket_rows=rows).selectExpr("row.doc_id", "lang", "source", "tokens", "budget", "mix_copies").collect()))
    assert mixed(0) == mixed(2) == mixed(10**6)


def test_leaks_survive_substitutions(spark):
    item = prose(40, 77)
    ws = item.split()
    swapped = " ".join("other" if i in (3, 15, 27) else w for i, w in enumerate(ws))
    short = " ".join(prose(9, 78).split())
    rows = [(1, prose(80, 5) + " " + item.upper() + ". " + prose(30, 6)), (2, prose(50, 7) + " " + swapped), (3, prose(300, 8)), (4, None), (5, ""), (6, prose(20, 9) + " " + short), (7, " ".join(ws[:6])), (None, item)]
    docs = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], DOCS)
    items = spark.createDataFrame([(0, item), (1, None), (2, "the"), (3, short), (4, "")], "item_id long, text string")
    for block in (50_000, 20):
        got = {(r.doc, r.item_id) for r in decontaminate.matches(docs, items, block_hashes=block).collect()}
        assert got == {(1, 0), (2, 0), (6, 3), (None, 0)}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, items).collect()) == [3, 4, 5, 7]
    assert decontaminate.matches(docs, items.limit(0)).count() == 0 and decontaminate.matches(empty_docs(spark), items).count() == 0


def test_a_prompt_of_many_items_is_dealt_to_a_grid(spark):
    """The shuffled join gives what the broadcast one gives, whatever share of either side one hash has."""
    prompt = prose(13, 40)
    items = spark.createDataFrame([(i, f"{prompt} {prose(12, 1000 + i)}") for i in range(60)] + [(60, None)], "item_id long, text string")
    texts = [f"{prose(20, i)} {prompt} {prose(20, 500 + i)}" for i in range(40)] + [prose(60, 900 + i) for i in range(20)] + [None, ""]
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    said = lambda **how: Counter(map(tuple, decontaminate.matches(docs, items, **how).collect()))
    want = said()
    assert len({x[:2] for x in want}) == len({i if i % 9 else None for i in range(40)}) * 60
    assert said(block_hashes=10, hot_rows=7) == want == said(block_hashes=10, hot_rows=10_000)
    hashes, masks = decontaminate.item_hashes(items)
    assert all(decontaminate._sieved(hashes.select("hash"), hashes).count() == hashes.count() for _ in masks[:1])
    others = spark.range(20_000).select(F.xxhash64("id").alias("hash"))
    assert decontaminate._sieved(others, hashes).count() < 100


def test_stages_take_columns_of_any_name(spark, tmp_path):
    odd = ["_bad", "a.b", "row", "tokens", "Shard", "said", "doc", "item", "`x`", "_id", "domain", "n", "did"]
    docs = odd_docs(spark).drop("shard", "score")
    for k, c in enumerate(odd):
        docs = docs.withColumn(c, F.lit(k))
    save(spark.createDataFrame([(0, prose(40, 32))], "item_id long, text string"), tmp_path, "benchmark")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        rows = got.collect()
        there = [c for c in odd if c != "Shard" or name != "shards"]  # which makes a column of that name
        assert {*docs.drop("Shard").columns, *there} <= set(got.columns), name
        if name != "quality_rules":  # which keeps none of these few
            assert rows and all(r[c] == k for r in rows for k, c in enumerate(odd) if c in there), name


def test_every_overlap_that_counts_is_hit(spark):
    """All placements of as many substitutions as verification accepts, in whole items of 8 to 13 words, and a long leaky copy."""
    rows, items = [], []
    for n, most in ((8, 1), (9, 1), (10, 2), (11, 2), (12, 2), (13, 2)):
        ws = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(ws)))
        for k in range(most + 2):  # one more is rejected
            for gone in combinations(range(n), k):
                said = " ".join("other" if i in gone else w for i, w in enumerate(ws))
                rows += [(len(rows), n, k <= most, said), (len(rows) + 1, n, k <= most, f"some words before {said} and after")]
    fifth = prose(60, 90).split()
    items.append((60, " ".join(fifth)))
    rows += [(len(rows), 60, True, " ".join("other" if i % 5 == 4 else w for i, w in enumerate(fifth))), (len(rows) + 1, 60, False, " ".join(fifth[:9])), (len(rows) + 2, 60, True, " ".join(fifth[:12]))]
    docs = spark.createDataFrame([(i, t) for i, _, _, t in rows], "doc_id long, text string")
    got = {(r.doc, r.item_id) for r in decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, n) for i, n, yes, _ in rows if yes}


def test_pipeline_decides_by_row(spark, tmp_path):
    base, leak = prose(120, 31), prose(40, 32)
    rows = [(None, prose(60, 33)), (None, prose(60, 34)), (None, prose(60, 35) + " " + leak), (None, None), (None, None), (5, base + " tail"), (7, base), (7, prose(60, 36)), (7, prose(60, 36)), (8, prose(60, 37)), (8, prose(50, 38) + " " + leak), (9, ""), (9, " ")]
    docs = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], DOCS)
    save(spark.createDataFrame([(0, leak)], "item_id long, text string"), tmp_path, "benchmark")
    said = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    once = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert once.columns == docs.columns and said(once) == Counter({x: 1 for x in rows if x != (7, base)})
    clean = Counter(x for x in rows if leak not in (x[1] or ""))
    assert said(corpus_pipeline.decontamination(spark, docs, str(tmp_path))) == clean


def test_pipeline_keeps_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, at, SF).write.parquet(f"{tmp_path}/{k}")
        before, at = at, spark.read.parquet(f"{tmp_path}/{k}")
        assert at.columns == docs.columns, name
        if name != "mixture":
            assert at.count() <= before.count() and at.exceptAll(before).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert last.count() == at.count() and {"shard", "slot"} <= set(last.columns)
