"""Repeated passages, fill-in-middle and the divergence of sources, against brute force and on odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import divergence, fim, repeats
from tests.llm.helpers import empty_docs, odd_docs, prose, save

SF = "/root/testdata/sf0.001"


def gone(rows, length):
    """For (id, bytes): True for each byte under a string of ``length`` that starts in a smaller id too."""
    least = {}
    for i, b in rows:
        for j in range(len(b) - length + 1) if i is not None else ():
            least[b[j : j + length]] = min(i, least.get(b[j : j + length], i))
    out = []
    for i, b in rows:
        mark = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1) if i is not None else ():
            if least[b[j : j + length]] < i:
                mark[j : j + length] = True
        out.append(mark)
    return out


def awkward(seed):
    """Texts that share passages at all offsets, runs of one byte, and texts about as long as a string."""
    r = random.Random(seed)
    shared = [prose(40, 100 + k) for k in range(4)] + ["-" * 90, "ab" * 60, "é" * 50]
    rows = []
    for k in range(60):
        parts = [prose(r.randrange(12), 1000 * seed + k)]
        for _ in range(r.randrange(3)):
            s = r.choice(shared)
            a = r.randrange(len(s))
            parts += [s[a : a + r.randrange(45, 130)], prose(r.randrange(6), r.randrange(10**6))]
        rows.append((r.choice([k, k, k % 7, None]), " ".join(parts)))
    return rows + [(3, "x" * 49), (4, "x" * 50), (99, "x" * 51), (98, ""), (97, None), (5, rows[0][1]), (200, rows[0][1])]


def local_run(rows, length, chunks, ranges):
    """All steps in this process, without Spark's exchanges."""
    tables = []
    for c in range(chunks):
        own = rows[c::chunks]
        raw = [(t or "").encode() for _, t in own]
        tables.append(pa.table({"_chunk": [c] * len(own), "_d": pa.array([i for i, _ in own], pa.int64()), "_t": pa.array([hash(t) for _, t in own], pa.int64()), "_text": pa.array(raw, pa.binary()), "_row": pa.array(list(range(c, len(rows), chunks)), pa.int64())}))
    made = [repeats.Chunk(t, length, ranges) for t in tables]

    def by(found, column, n):
        return [found.filter(pa.array(np.asarray(found[column]) == k)) for k in range(n)]

    every = pa.concat_tables([repeats.entries(c, k) for k, c in enumerate(made)])
    first = pa.concat_tables([repeats.compared(t) for t in by(every, "range", ranges) if t.num_rows])
    sought = pa.concat_tables([repeats.sought(c, t, k, ranges) for k, (c, t) in enumerate(zip(made, by(first, "chunk", chunks)))])
    both = pa.concat_tables([first, *[repeats.resolved(t, length) for t in by(sought, "range", ranges) if t.num_rows]])
    out = [repeats.results(c, t, x) for c, t, x in zip(made, by(both, "chunk", chunks), tables)]
    return sought, {r["_row"]: r for t in out for r in t.to_pylist()}


@pytest.mark.parametrize("length, hot, chunks", [(50, 20_000, 3), (50, 1, 4), (21, 1, 2), (33, 20_000, 1), (83, 2, 5)])
def test_repeats_equal_brute_force_in_one_process(monkeypatch, length, hot, chunks):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SLICE", 700)  # long texts are parsed in slices
    repeats._tables.cache_clear()
    for seed in range(4):
        rows = awkward(seed)
        sought, got = local_run(rows, length, chunks, 5)
        assert any(b is None for b in sought["bytes"].to_pylist()) or hot > 2
        for k, mark in enumerate(gone([(i, (t or "").encode()) for i, t in rows], length)):
            edges = np.flatnonzero(np.diff(np.r_[False, mark, False].astype(int)))
            assert got[k]["n_removed"] == mark.sum() and got[k]["spans"] == edges.tolist(), (seed, k)
    repeats._tables.cache_clear()


def test_repeats_on_spark_in_many_chunks(spark):
    rows = awkward(7)
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, `a.b` long")
    got = {r["a.b"]: r for r in repeats.remove_repeats(df, chunk_bytes=500, range_bytes=900).collect()}
    for k, mark in enumerate(gone([(i, (t or "").encode()) for i, t in rows], 50)):
        raw = np.frombuffer((rows[k][1] or "").encode(), np.uint8)
        assert bytes(got[k].kept) == raw[~mark].tobytes() and got[k].n_bytes == len(raw) and got[k].n_spans == len(got[k].spans) // 2


def test_op12_equals_brute_force(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in repeats.op12_suffix_array_dedup(spark, SF).collect()}
    for (i, b), mark in zip(rows, gone(rows, 50)):
        kept = np.frombuffer(b, np.uint8)[~mark].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), mark.sum(), hashlib.sha256(kept).hexdigest())


def test_each_string_has_one_trigger_wherever_it_stands():
    """Equal strings fall into blocks with equal triggers, at the same distance, whatever stands around them."""
    string, seen = prose(30, 5).encode()[:50], set()
    for k in range(50):
        data = np.frombuffer(prose(9, k).encode() + string + prose(9, 99 + k).encode(), np.uint8)
        at = data.tobytes().index(string)
        p = repeats.Parse(data, np.arange(len(data)) <= len(data) - 50, 50)
        own = np.flatnonzero((p.start <= at) & (at < p.end))
        assert len(own) == 1 and (np.diff(p.start) > 0).all()
        seen.add((int(p.trigger[own[0]]), int(p.at[own[0]] - at)))
    assert len(seen) == 1


@pytest.mark.parametrize("unit", [None, r"\w+", r"[^\n]*\n"])
def test_ropes_split_like_strings(unit):
    pattern = unit and re.compile(unit)
    for seed in range(60):
        r = random.Random(seed)
        text = "".join(r.choice(["a", "é", "\U0001f600", " ", "\n", "<", "P>"]) for _ in range(r.randrange(60)))
        leaf = r.randrange(1, 6)
        tree = fim.rope(text, pattern, leaf)
        tiles = [x for x in re.split(f"({unit})", text) if x] if unit else list(text)
        assert (tree.units, tree.points, fim.written(tree)) == (len(tiles), len(text), text)
        k = r.randrange(len(tiles) + 2)
        a, b = fim.split(tree, k)
        assert (fim.written(a), fim.written(b)) == ("".join(tiles[:k]), "".join(tiles[k:])) and (a.units, b.points) == (min(k, len(tiles)), len("".join(tiles[k:])))
        both = fim.join(b, a)
        assert fim.written(fim.split(both, 3, points=True)[0]) == fim.written(both)[:3]
        if "<" in text:
            assert fim.find(tree, "<") == text.index("<")
        out, form, *_ = fim.rearrange(text, str(seed), pattern, leaf=leaf)
        assert fim.restore(out, form, leaf) == text and (form == "plain" or out != text)


def test_ropes_are_shallow():
    def depth(r):
        return 1 + max(depth(r.left), depth(r.right)) if isinstance(r, fim.Node) else 0

    assert depth(fim.rope("x" * 1_000_000, leaf=100)) <= 14


def test_fill_in_middle_on_odd_rows(spark):
    odd = odd_docs(spark).withColumnRenamed("score", "fim_text").withColumnRenamed("shard", "a.b")
    out = fim.restored(fim.fill_in_middle(odd))
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    for r in out.collect():
        assert r.fim_restored == (r.text or "") and r.fim_units == len(r.text or "")
        assert r.fim_form == "plain" or len(r.fim_text) == len(r.text) + 9
    assert fim.fill_in_middle(empty_docs(spark)).count() == 0
    words = fim.fill_in_middle(odd, unit=r"\S+\s*", rate=100, spm=100).where("fim_form = 'spm'").collect()
    assert words and all(fim.restore(r.fim_text, "spm") == r.text and r.fim_text.startswith(fim.SUFFIX) for r in words)
    planted = spark.createDataFrame([(i, f"a <{m}> b") for i in range(9) for m in "PSM"], "doc_id long, text string")
    assert {r.fim_form for r in fim.fill_in_middle(planted, rate=100).collect()} == {"plain"}


def audit(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in d[2])
        kept = sorted(t for t in held if held[t] >= min_docs)
        counts = {None: Counter()} | {d[1]: Counter() for d in mine}
        for _, source, c in mine:
            counts[source].update(c)
            counts[None].update(c)
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts.keys() - {None}:
            parts = {"pair": [(h, sum(f(p[s][t], p[h][t]) for t in kept)) for h in counts.keys() - {None, s}], "term": [(t, f(p[s][t], p[None][t])) for t in kept if counts[s][t] and p[s][t] > p[None][t]]}
            for part, items in parts.items():
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(items[: None if part == "pair" else top], 1)]
    return sorted(out)


@pytest.mark.parametrize("heavy", [0.0, 0.25, 1.0])
def test_divergence_equals_brute_force_whatever_is_heavy(spark, heavy):
    r = random.Random(3)
    rows = [(prose(r.randrange(60), k) + r.choice(["", " Große ÄRA-x", " 漢字 UP_up"]), r.choice(["en", "de", None]), f"s{int(r.paretovariate(0.6)) % 17}") for k in range(150)]
    rows += [(None, "en", "silent"), ("", "lone", None), ("", "lone", "other"), ("123 456", "", None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sorted(tuple(x) for x in divergence.divergence(df, heavy=heavy).collect())
    assert got == audit(rows)


def test_divergence_by_tiles(spark):
    """Blocks of two groups and several salts, in this process and through Spark's groups."""
    rows = [(prose(30, k % 40), "en", f"s{k % 5}") for k in range(60)]
    found = divergence.divergence(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert sorted(tuple(x) for x in found.collect()) == audit(rows)
    ids, z = [0, 1, 300, 301], [7, 11, 13, 17]
    sent = [(0, "", g, p, 3) for g, p in zip(ids, z)] + [(1, "a", 0, 40, None), (1, "a", 300, 50, None), (1, "b", 1, 60, None), (2, "c", 0, 9, None), (2, "c", 1, 8, None), (2, "c", 301, 70, None)]
    kind, term, gid, p, terms = zip(*sent)
    n = len(sent)
    t = pa.table({"lang": ["en"] * n, "x": [0] * n, "y": [1] * n, "salt": [0] * n, "kind": pa.array(kind, pa.int32()), "term": list(term), "gid": list(gid), "p": list(p), "terms": pa.array(terms, pa.int64())})
    shares = {k: dict(zip(ids, z)) for k in "abc"}
    for _, k, g, v, _ in sent[4:]:
        shares[k][g] = v
    want = {(g, h): sum((s[g] - s[h]) ** 2 // s[h] for s in shares.values()) for g in ids for h in ids if (g < 256) != (h < 256)}
    assert {(r["g"], r["h"]): r["value"] for r in divergence.tile_sums(t).to_pylist()} == want


def test_divergence_of_empty_and_odd_tables(spark, tmp_path):
    assert divergence.divergence(empty_docs(spark)).count() == 0
    odd = odd_docs(spark).withColumnRenamed("shard", "a.b")
    assert sorted(tuple(r) for r in divergence.divergence(odd).collect()) == audit([(r.text, r.lang, r.source) for r in odd.collect()])
    src = save(odd_docs(spark), tmp_path, "documents")
    assert repeats.op12_suffix_array_dedup(spark, src).count() == 10 and fim.op13_fill_in_middle(spark, src).count() == 10
    src = save(empty_docs(spark), tmp_path, "documents")
    assert repeats.op12_suffix_array_dedup(spark, src).count() == 0 and divergence.op11_source_divergence(spark, src).count() == 0 and fim.op13_fill_in_middle(spark, src).count() == 0
