import hashlib
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.llm import chat, gru, html, langid, lm, minhash, toxicity
from tests.llm.helpers import DOCS, crc, empty_docs, odd_docs, prose, save


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, set()).update({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else ())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in ids}


def test_components_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(i, t) for i, t in enumerate([None, "", "one", "one", "two words", "two words"])]
    for g in range(6):
        base = prose(60, 100 + g).split()
        for _ in range(14):
            ws = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 3, 9))):
                ws[r.randrange(len(ws))] = f"new{r.randrange(10**6)}"
            rows.append((len(rows) + 10, " ".join(ws[: r.choice((60, 60, 55, 50))])))
    docs = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], DOCS)
    for width in (4, 5):
        got = {x.doc: x.component for x in minhash.near_duplicates(docs, width=width).collect()}
        assert got == brute_components(rows, width, 80)


def test_near_duplicates_of_odd_rows(spark):
    got = minhash.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == 10 and {r.doc: r.component for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, None: None, 5: 5, 6: 6, 7: 7, 8: 1}
    assert sorted(str(r.doc_id) for r in minhash.deduplicate(odd_docs(spark)).collect()) == sorted(map(str, (1, 3, 4, None, 5, 6, 7)))
    assert minhash.near_duplicates(empty_docs(spark)).count() == 0


def test_rows_of_one_id_are_judged_each(spark):
    """Repeated ids with different texts, null ids, and a component that has both."""
    a, b, c = prose(60, 201), prose(60, 202), prose(60, 203)
    rows = [(7, a), (7, b), (3, b + " tail"), (None, a), (None, c), (None, None), (9, c), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc, r.n_shingles, r.component) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter([(7, 56, 7), (7, 56, 3), (3, 57, 3), (None, 56, 7), (None, 56, 9), (None, 0, None), (9, 56, 9), (9, 0, 9)])


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900, np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100, np.uint64)])
    mul, add = minhash.permutations(400)
    same = (minhash.min_max(np.sort(a), mul, add) == minhash.min_max(np.sort(b), mul, add)).mean()
    assert abs(same - 0.8) < 0.05


def test_language(spark, tmp_path):
    folder = save(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), tmp_path, "documents")
    got = {r.doc_id: r for r in langid.op3_language_id(spark, folder).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = [i for i in truth if crc(i, 5) == 0]
    assert all(got[i].held_out == (crc(i, 5) == 0) for i in truth)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95 and all(0 <= r.score <= 1 for r in got.values())


def test_language_of_odd_rows(spark, tmp_path):
    for docs, n in ((odd_docs(spark), 10), (empty_docs(spark), 0)):
        got = langid.op3_language_id(spark, save(docs, tmp_path, "documents")).collect()
        assert len(got) == n and all(r.lang_pred == "und" for r in got if r.doc_id in (3, 4, 5))
    assert langid.Classifier({"a": b"some words", "b": b"andere woerter"})("12 !?")[0] == "und"


def test_toxicity_catches_planted_words(spark, tmp_path):
    rows = [(i, prose(60, i) + (" you vile fool" if i % 5 == 0 else ""), None, None, None, None, None) for i in range(400)]
    save(spark.createDataFrame(rows, DOCS), tmp_path, "documents")
    save(spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    got = toxicity.op8_toxicity(spark, str(tmp_path)).collect()
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in got)


def test_toxicity_learns_a_pair():
    r = random.Random(0)
    rows, y = [], []
    for _ in range(1500):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(np.array(sorted({7} | ({11} if a else set()) | ({13} if b else set()))))
        y.append(int(a and b))
    m = toxicity.learn(rows, np.array(y), epochs=60)
    s = m.scores([np.array([7, 11, 13]), np.array([7, 11]), np.array([7, 13]), np.array([7])])
    assert s[0] > 0.7 and max(s[1:]) < 0.3


def test_toxicity_learns_terms_that_are_neutral_alone():
    """Toxic is one of two terms, not both: neither goes with the label by itself."""
    r = random.Random(5)
    rows, y = [], []
    for _ in range(2500):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(np.array(sorted({r.randrange(1000, 1400) for _ in range(20)} | ({11} if a else set()) | ({13} if b else set()))))
        y.append(int(a != b))
    m = toxicity.learn(rows[:2000], np.array(y[:2000]))
    assert ((m.scores(rows[2000:]) >= 0.5) == y[2000:]).mean() > 0.95


def test_pairs_equal_the_sum_over_all():
    rng = np.random.default_rng(4)
    m = toxicity.Machine(0.3, rng.normal(size=40), rng.normal(size=(40, 8)))
    rows = [np.array([], np.int64), np.array([5]), np.array([1, 7, 30, 39])]
    for got, r in zip(m.raw(rows), rows):
        assert math.isclose(got, 0.3 + sum(m.w[i] for i in r) + sum(m.v[i] @ m.v[j] for k, i in enumerate(r) for j in r[k + 1 :]))


def test_toxicity_of_odd_rows(spark, tmp_path):
    save(spark.createDataFrame([(1, 1, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    for docs, n in ((odd_docs(spark), 10), (empty_docs(spark), 0)):
        assert toxicity.op8_toxicity(spark, save(docs, tmp_path, "documents")).count() == n


def test_gradients():
    rng = np.random.default_rng(0)
    g = gru.Gru(np.array([5.0, 3, 9, 1, 4, 2, 7, 8]), 0)
    g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    x, f, y, live, h, _ = next(g._windows([rng.integers(0, 8, n) for n in (5, 9, 3)], 2, {}))
    grad, *_ = g._step(x, f, y, live, h)
    loss = lambda: -g._out(g._run(x, f, h, keep=True)[0], y, live)[0].sum() / live.sum()
    for k in gru.NAMES:
        i = tuple(rng.integers(0, s) for s in g.p[k].shape)
        was = g.p[k][i]
        g.p[k][i] = was + 1e-4
        up = loss()
        g.p[k][i] = was - 1e-4
        down = loss()
        g.p[k][i] = was
        assert math.isclose(grad[k][i], (up - down) / 2e-4, rel_tol=0.05, abs_tol=1e-5)


def test_a_document_is_scored_alike_in_any_company():
    rng = np.random.default_rng(2)
    g = gru.Gru(rng.random(30) * 9, 0)
    docs = [rng.integers(0, 30, n) for n in (1, 70, 3, 41, 20, 1500)]
    assert np.allclose(g.score(docs), [g.score([d])[0] for d in docs], atol=1e-3)
    p = np.exp([g.score([np.array([5, k])])[0] - g.score([np.array([5])])[0] for k in range(30)])
    assert math.isclose(p.sum(), 1, rel_tol=1e-3)


def test_lm_base_and_score(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in lm.op6_lm_score(spark, "/root/testdata/sf0.001").collect()}
    toks = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for i, t in rows.items() if crc(i, 7) != 2 for w in toks(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows.items():
        r, ws = got[i], toks(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 7) == 2, len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_pieces_make_no_false_starts():
    """Each text begins with one word and then goes round nine others; most pieces begin elsewhere, on a word told by the one before."""
    docs = [np.array([1, *[2 + (i + k) % 9 for k in range(1_200)], 0]) for i in range(20)]

    def learned(lead):
        parts = [(d[max(0, k - lead) : k + lm.PIECE], min(k, lead)) for d in docs for k in range(0, len(d), lm.PIECE)]
        model = gru.Gru(np.ones(11), 0)
        model.train([p for p, _ in parts], 12, 2e-2, leads=[n for _, n in parts])
        return math.exp(model.score([np.array([1])])[0]), model.score([docs[3]])[0] / len(docs[3])

    (first, whole), (false, _) = learned(lm.LEAD), learned(0)
    assert first > 0.8 > 0.6 > false and whole > -0.1


def test_pieces_hold_every_word_once_to_learn():
    texts = [" ".join(f"w{(i + k) % 97}" for k in range(n)) for i, n in enumerate((0, 1, 499, 500, 1_203))]
    lexicon = lm.Lexicon([b"w%d" % k for k in range(97)] + [lm.END], np.full(98, 9), np.zeros(2 * lm.SHAPES), 900, 98)
    held = type("Held", (), {"id": "pieces", "value": (lexicon, gru.Gru(lexicon.freq(), lexicon.end).flat())})
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], ["h", "text"])
    rows = [r for out in lm._pieces(held)(iter([batch])) for r in out.to_pylist()]
    for i, text in enumerate(texts):
        mine = sorted((r["at"], np.frombuffer(r["symbols"], np.int16)) for r in rows if r["h"] == i)
        want = [*[int(w[1:]) for w in text.split()], 97]
        assert [int(x) for at, part in mine for x in part[min(at, lm.LEAD) :]] == want
        assert all(list(part) == want[max(0, at - lm.LEAD) : at + lm.PIECE] for at, part in mine)


def test_leads_are_not_learned_but_carry_the_state():
    rng = np.random.default_rng(4)
    doc = rng.integers(0, 30, 90)
    g = gru.Gru(rng.random(30) * 9, 0)
    cells = lambda docs, leads: [(int(b), tuple(c)) for x, _, y, live, _, d in g._windows(docs, 2, {}, leads) for b, *c in zip(d[live], x[live], y[live])]
    want = [c for _, c in cells([doc], None)]
    got = sorted(cells([doc[:50], doc[40:]], [0, 10]))
    assert [c for _, c in got] and sorted(c for _, c in got) == sorted(want)


def test_texts_of_many_slices_are_scored_side_by_side(monkeypatch):
    """A long text in each slice: the lanes beside it are filled, so steps follow the tokens and not one long text for each slice."""
    monkeypatch.setattr(lm, "SLICE_ROWS", 20)
    texts = [" ".join(f"w{(i + k) % 97}" for k in range(4_000 if i % 20 == 19 else i % 7)) for i in range(160)]
    lexicon = lm.Lexicon([b"w%d" % k for k in range(97)] + [lm.END], np.full(98, 9), np.zeros(2 * lm.SHAPES), 900, 98)
    model = gru.Gru(lexicon.freq(), lexicon.end)
    held = type("Held", (), {"id": "side by side", "value": (lexicon, model.flat())})
    run, steps = gru.Gru._run, []
    monkeypatch.setattr(gru.Gru, "_run", lambda self, x, *more, **known: steps.append(len(x)) or run(self, x, *more, **known))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 40), pa.int64()), pa.array(texts[k : k + 40])], ["uid", "text"]) for k in range(0, 160, 40)]
    rows = [r for out in lm._score(held)(iter(batches)) for r in out.to_pylist()]
    assert [r["uid"] for r in rows] == list(range(160)) and sum(steps) <= 4_001 + gru.WINDOW
    lexicon.ready()
    alone = [model.score([lexicon.encode(pa.array([t]))[1]])[0] / lm.LOG10 for t in texts]
    assert np.allclose([r["score"] for r in rows], alone, rtol=1e-5) and [r["n_tokens"] for r in rows] == [len(t.split()) + 1 for t in texts]


def test_lm_learns_from_every_document(spark):
    """Two corpora of equal counts, apart only in documents beyond the warm start and beyond one in 64."""
    rows, at = 600, spark.range(600).select("id", F.xxhash64(F.lit(lm.SEED), "id").alias("h"))
    far = {r.id for r in at.where((F.pmod("h", F.lit(1 << 30)) >= 1.2 * lm.WARM_DOCS / rows * (1 << 30)) & (F.pmod(F.shiftright("h", 32), F.lit(64)) != 0)).collect()}
    said = ("yin yang " * 100, "yin yin yang yang " * 50)
    assert len(far) > 100

    def learned(text):
        docs = spark.createDataFrame([(i, text if i in far else prose(20, i)) for i in range(rows)], "doc_id long, text string").repartition(2)
        lexicon = lm.lexicon_of(lm.counted(docs))
        return lexicon.ready(), gru.Gru(lexicon.freq(), lexicon.end).load(lm.fit(docs, lexicon))

    got = [[m.score([x.encode(pa.array([t]))[1]])[0] for t in said] for x, m in map(learned, said)]
    assert got[0][0] - got[0][1] > got[1][0] - got[1][1] + 0.1  # each prefers what it was trained on


def test_what_is_learned_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 20_000)
    docs = spark.createDataFrame([(i, prose(300, i)) for i in range(200)] + [(None, "null id"), (None, None), (3, "again")], "doc_id long, text string")
    lexicon = lm.lexicon_of(lm.counted(docs))
    one, other = (lm.fit(docs.repartition(n), lexicon) for n in (2, 7))
    assert np.allclose(one, other, atol=1e-6)


def test_lm_of_odd_rows(spark, tmp_path):
    for docs, n in ((odd_docs(spark), 10), (empty_docs(spark), 0)):
        got = lm.op6_lm_score(spark, save(docs, tmp_path, "documents")).collect()
        assert len(got) == n and all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_chats_read_back(spark, tmp_path):
    rows = [(1, 1, "assistant", "</s>[INST] x", 0), (1, 0, "user", None, 0), (1, 2, None, "⁠[", 0), (2, 0, "assistant", "same", 1), (2, 0, "assistant", "same", 1), (None, 0, "system", "s", 0), (3, 0, "assistant", "x" * 50_000 + "é😀", 0)]
    folder = save(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss_chars int"), tmp_path, "conversations")
    got = {r.conv_id: r for r in chat.op10_chat_format(spark, folder).collect()}
    assert set(got) == {-1, 1, 2, 3, None}
    said = "</s>[INST] ok [/INST]"
    want = {-1: [("user", said), ("assistant", said)], 1: [("user", ""), ("assistant", "</s>[INST] x"), ("", "⁠[")], 2: [("assistant", "same")] * 2, 3: [("assistant", rows[-1][3])], None: [("system", "s")]}
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns) and got[k].loss_chars == len(loss)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip_of_random_turns():
    r, parts = random.Random(1), ["<", "s", ">", "/", "[", "INST", "]", "⁠", " ", "TURN", "SYS", "é", "😀"]
    for _ in range(1500):
        turns = [(r.choice(["user", "assistant", "system", "x [", ""]), "".join(r.choice(parts) for _ in range(r.randrange(9)))) for _ in range(r.randrange(5))]
        text, spans = chat.render(turns)
        e = chat.load(chat.TOKENIZER).encode(text, add_special_tokens=False)
        assert chat.parse(text) == turns
        assert chat.masked_text(text, spans, e.offsets, chat.mask_tokens(e.offsets, spans)) == "".join(t for k, t in turns if k == "assistant")


PAGE = "<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><div class='ad'>buy</div>{side}<div class=content><h2>{t}</h2><p>{a} &amp; more<p>{b}</div><div class=comments><p>I agree</p></div><p>Same notice on every page.</p><footer>f</footer></body></html>"


def test_wrappers_find_the_article(spark, tmp_path):
    rows = [(i, f"https://u@host{i % 2}.example:80/x?{i}", PAGE.format(side="<aside>s</aside>" if i % 3 else "", t=f"Title {i}", a=prose(30, i), b=prose(20, i + 50)), "x") for i in range(8)]
    rows += [(8, None, None, None), (9, "odd", "", None), (9, "odd", "<p>alone</p><script>x</script>", None), (10, "https://host0.example/", "<div>" * 3000 + "deep text" + "</div>" * 10, None)]
    folder = save(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), tmp_path, "pages")
    got = [(r.page_id, r.text, r.n_chars) for r in html.op1_html_extract(spark, folder).collect()]
    text = {i: t for i, t, _ in got if i < 8}
    for i in range(8):
        assert text[i] == f"Title {i}\n{prose(30, i)} & more\n{prose(20, i + 50)}"
    assert len(got) == 12 and all(n == len(t) for _, t, n in got)
    assert sorted(t for i, t, _ in got if i in (8, 9, 10)) == ["", "", "alone", "deep text"]


def test_copies_and_few_pages_make_no_boilerplate(spark):
    page = "<html><body><div class=x><h1>{t}</h1><div>{lone}</div><p>{a}</p><p>{b}</p></div></body></html>"
    copies = [(i, "http://copies.example/", page.format(t="Title", lone="lone block", a="one", b="two")) for i in range(4)]
    large = [(10 + i, "http://large.example/", page.format(t=f"T{i}", lone="lone block", a=prose(9, i), b=prose(9, 50 + i)).replace("<div>lone block</div>", "<div>lone block</div>" if i < 3 else "")) for i in range(40)]
    same = [(60 + i, "http://same.example/", page.format(t=f"T{i}", lone="lone block", a=prose(9, i), b=prose(9, 50 + i))) for i in range(40)]
    pages = spark.createDataFrame(copies + large + same, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in html.extract(pages).collect()}
    assert all(got[i] == ["Title", "lone block", "one", "two"] for i in range(4))
    assert all(got[10 + i] == [f"T{i}", *["lone block"] * (i < 3), prose(9, i), prose(9, 50 + i)] for i in range(40))
    assert all(got[60 + i] == [f"T{i}", prose(9, i), prose(9, 50 + i)] for i in range(40))


def test_template_texts_are_counted_over_all_pages(spark):
    """A sentence of 32 stories of 40 stays; a notice and an invitation on all pages go, within an article or ``main`` too."""
    story = "<html><body><div class=x><p>{a}</p><p>{s}</p><p>{b}</p></div></body></html>"
    most = [(i, "http://most.example/", story.format(a=prose(9, i), b=prose(9, 50 + i), s="Shares fell." if i < 32 else f"Shares rose {i}.")) for i in range(40)]
    notice = [(100 + i, "http://notice.example/", f"<article><div class=zz>We use cookies.</div><p>{prose(9, i)}</p></article>") for i in range(20)]
    letter = [(200 + i, "http://letter.example/", f"<main><p>{prose(9, i)}</p><div>Subscribe to our letter</div></main>") for i in range(20)]
    few = [(300 + i, "http://few.example/", f"<article><h2>Summary</h2><p>{prose(9, i)}</p></article>") for i in range(4)]
    pages = spark.createDataFrame(most + notice + letter + few, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert all(got[i] == f"{prose(9, i)}\n{'Shares fell.' if i < 32 else f'Shares rose {i}.'}\n{prose(9, 50 + i)}" for i in range(40))
    assert all(got[k + i] == prose(9, i) for k in (100, 200) for i in range(20))
    assert all(got[300 + i] == f"Summary\n{prose(9, i)}" for i in range(4))
    # Equal to counting by hand, a page's free text telling it from others.
    for host, rows in (("most.example", most), ("notice.example", notice), ("few.example", few)):
        by = {html._mark(n): html.places(n) for n in (html.parse(r[2]) for r in rows)}
        often = Counter(x for p in by.values() for x in p)
        want = sorted(x for x, n in often.items() if len(by) >= (html.INSIDE_PAGES if x & 1 else html.SAME_PAGES) and 100 * n >= html.SAME_PERCENT * len(by))
        found = html.template_texts(pages.select(html.host_of(F.col("url")).alias("host"), "html")).where(F.col("host") == host).collect()
        assert (found[0].same if found else []) == want


def test_wrapper_is_a_union_free_expression():
    pages = ["<ul><li>a<li>b</ul><p>x</p>", "<ul><li>c</ul><h1>t</h1><p>x</p>"]
    w = html.join(*[html.wrap(html.parse(p)) for p in pages])
    assert html.expression(w) == "((<ul> (<li> #text </>)+ </>) (<h1> #same </>)? (<p> #same </>))"


def test_only_other_pages_tell_the_article(spark):
    """Names say nothing, notices have several paragraphs, and the paragraphs of the story repeat like theirs."""
    page = f"<html><body><div class=qa><p>{prose(20, 300)}<p>{prose(9, 301)}</div><div class=qb><p>{{a}}<p>{{b}}</div><div class=z{{k}}><p>{prose(12, 302)}<p>All rights.</div></body></html>"
    rows = [(i, "http://h.example/", page.format(a=prose(12, i), b=prose(15, 50 + i), k=i % 3)) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got == {i: f"{prose(12, i)}\n{prose(15, 50 + i)}" for i in range(6)}
    alone = [html.main_text(r[2], None) for r in rows]
    assert sum(got[i] != alone[i] for i in range(6)) == 6  # a page alone doesn't tell
    # The same whatever the partitioning, and by a shuffled join of rules.
    for n in (1, 5):
        assert {r.page_id: r.text for r in html.extract(pages.repartition(n)).collect()} == got


def test_alignment_equals_brute_force():
    """Kids that both sides have in order, as many as the longest common subsequence by trying all."""
    r = random.Random(7)
    for _ in range(200):
        a, b = ([[r.choice("uvwxyz"), "1", 1, 0, 0, [], []] for _ in range(r.randrange(5))] for _ in range(2))
        a, b = ([w for k, w in enumerate(x) if w[0] not in [v[0] for v in x[:k]]] for x in (a, b))  # nothing to fold
        x, y = [w[0] for w in a], [w[0] for w in b]
        longest = max(n for n in range(len(x) + 1) for c in combinations(x, n) if any(c == d for d in combinations(y, n)))
        out = html.align(a, b)
        if not any(w[0] == "()" or w[1] in "+*" for w in out):
            assert sum(w[2] == 2 for w in out) == longest


def test_long_mixed_articles_and_odd_markup():
    body = "".join(r if k % 3 else f"<h2>h{k}</h2>" + r for k, r in enumerate(random.Random(1).choices(["<p>a b</p>", "<ul><li>c</ul>", "<blockquote>d</blockquote>"], k=120)))
    one = html.wrap(html.parse(f"<main>{body}</main>"))
    assert len(html.align(one[6], html.wrap(html.parse("<main><p>x</main>"))[6])) < 8
    assert len(html.main_text(f"<main>{body}</main>", None).split("\n")) == 160
    assert html.main_text("<article><p class=it's>a</p><ul class=refs><li><a href=x>one</a><li><a>two</a></ul><section class='market share'>s</section><div id=social>t</div><div class=share><a>no</a></div><div class=comments>c</div></article>", None) == "a\none\ntwo\ns\nt"


@pytest.mark.parametrize("page, want", [("a<br>b", "a b"), ("<p>a<p>b", "a\nb"), ("<main><p>m</main><p>n", "m"), ("<!-- x --><p>&lt;i&gt;", "<i>"), ("<table><tr><td>a<td>b</table>", "a\nb"), ("", "")])
def test_single_pages(page, want):
    assert html.main_text(page, None) == want
