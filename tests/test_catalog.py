import base64
import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
from evidentia import catalog
from evidentia.functions import binary as B

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(repr(x) for x in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert len(entry.entry(spark).take(5)) == 5


def test_scripts_are_read_whole(spark, tmp_path):
    """deobfuscate and base64_decode over whole texts, against brute force."""
    long = "x" * 200_000 + " 'the end' \U0001f600\r\n"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(-1, long), (-2, None), (-3, ""), (-4, "ab$1")]
    spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    said = {i: (t or "").replace('"', "'").replace("\n", " ") for i, t in rows}
    got = {r.doc_id: (r.joined, r.reversed) for r in catalog.deobfuscate(spark, str(tmp_path)).collect()}
    assert got == {i: (t, t[::-1]) if len(t) >= 6 else ("", "") for i, t in said.items()}
    want = {}
    for i, t in rows:
        raw = (t or "").encode()
        blob = base64.b64encode(raw).decode()
        if len(blob.rstrip("=")) >= 40:
            wide, narrow = raw.decode("utf-16-le", "replace"), raw.decode("utf-8", "replace")
            text = wide if sum(map(str.isprintable, wide)) > sum(map(str.isprintable, narrow)) else narrow
            shown = text if sum(c.isprintable() or c in "\r\n\t" for c in text) > 0.5 * len(text) else raw[:512].hex()
            shown = shown if len(shown) <= 3000 else f"{shown[:3000]}\n...[truncated {len(shown) - 3000} chars]"
            want[i] = (len(blob), hashlib.md5(shown.encode()).hexdigest(), round(B.entropy_of(raw), 6))
    assert {r.doc_id: (r.encoded_length, r.preview, round(r.entropy, 6)) for r in catalog.base64_decode(spark, str(tmp_path)).collect()} == want and max(w[0] for w in want.values()) > 200_000
