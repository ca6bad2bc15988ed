"""What is dealt by blocks, bins and tables of rows, against the plain way."""

import io
import random
import tracemalloc
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from evidentia import sources
from evidentia.functions import binary as B
from evidentia.functions import tables
from evidentia.operators import network, trace
from tests.made_files import make_pdf


def test_trace_lines_are_numbered_over_split_files(spark, tmp_path):
    r = random.Random(1)
    want = {}
    for k in range(5):
        lines = ["".join(r.choice("abcdef ") for _ in range(r.randrange(60))) for _ in range(r.choice([0, 1, 700, 3000]))]
        (tmp_path / f"job{k}.trace.log").write_text("\n".join(lines))
        want |= {(f"job{k}.trace", i): x for i, x in enumerate(lines, 1) if x and i <= 2500}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")  # many blocks a file, several blocks a task
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        got = sources.trace_lines(spark, str(tmp_path), 2500)
        assert {(x.job_id, x.line_no): x.line for x in got.collect()} == want and got.count() == len(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window") <= 3 and "Window [line" not in plan  # over blocks alone
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_busy_address_is_parted_by_time(spark):
    """One address has nearly all flows and many jobs, some of which overlap, touch a bin's edge, last no time, or end before they start."""
    r = random.Random(2)
    jobs, flows = [], []
    for k in range(200):
        a = float(r.choice([r.uniform(0, 90_000), 3600 * r.randrange(25)]))
        jobs.append((f"j{k}", "10.0.0.1" if k % 10 else "10.0.0.2", a, a + r.choice([0, 5, 300, 3600, 9000, -1])))
    flows = [(i, "10.0.0.1" if i % 20 else "10.0.0.2", r.choice([jobs[i % 200][2], jobs[i % 200][3], r.uniform(0, 90_000)])) for i in range(3000)]
    time = lambda c: F.timestamp_micros(F.round(F.col(c) * 1e6).cast("long"))
    j = spark.createDataFrame(jobs, "job_id string, worker_ip string, a double, z double").select("job_id", "worker_ip", time("a").alias("started_at"), time("z").alias("finished_at"))
    f = spark.createDataFrame(flows, "n int, src string, t double").select("n", "src", time("t").cast("string").alias("ts"))
    micro = lambda x: round(x * 1e6)
    want = sorted((n, k) for n, s, t in flows for k, ip, a, z in jobs if s == ip and micro(a) <= micro(t) <= micro(z))
    for seconds in (3600, 60, 100_000):
        got = network.match(f, j, bin_seconds=seconds)
        assert sorted((x.n, x.job_id) for x in got.collect()) == want and got.columns == ["n", "src", "ts", "job_id"]


def test_table_functions_equal_the_dataframe_forms(spark):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "one")
        z.writestr("d/b.bin", bytes(50))
    document = make_pdf({1: {"/Type": "/Catalog", "/Pages": (2,)}, 2: {"/Type": "/Pages", "/Kids": []}}, streams={3: ({}, b"in a stream")})
    rows = [(1, bytearray(packed.getvalue())), (2, bytearray(document)), (3, None), (4, bytearray(b"plain text here\0plain text here\0other text"))]
    files = spark.createDataFrame(rows, "id int, content binary")
    tables.register(spark)
    files.createOrReplaceTempView("files_for_tables")
    got = lambda q: sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in spark.sql(q).collect())
    m = files.select("id", F.explode(B.archive_members(F.col("content"))).alias("m")).select("id", "m.name", "m.content")
    assert got("SELECT id, m.name, m.content FROM files_for_tables, LATERAL archive_members(content) AS m") == sorted((r.id, r.name, bytes(r.content)) for r in m.collect()) and m.count() == 2
    s = files.select("id", F.posexplode(B.pdf_facts(F.col("content"))["streams"])).collect()
    assert got("SELECT id, s.position, s.content FROM files_for_tables, LATERAL pdf_streams(content) AS s") == sorted((r.id, r.pos, r.col.encode("latin-1")) for r in s) and len(s) == 1
    assert [r for r in got("SELECT id, s.position, s.run FROM files_for_tables, LATERAL printable_strings(content, 9) AS s") if r[0] == 4] == [(4, 0, "plain text here"), (4, 1, "other text")]


def test_triage_reads_bytes_where_their_batch_lies():
    """Peak of Python's own memory over a batch of 60 MB: a file at a time, not the batch once more as objects."""
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "one")
        z.writestr("é.txt", "two")
    odd = [None, b"", b"aab", bytes(range(256)), packed.getvalue(), packed.getvalue()[:40]]
    batch = pa.array(odd + [bytes([k % 256]) + bytes(65_535) for k in range(950)], pa.binary())
    B.entropy.each(batch[:9]), B.zip_names.each(batch[:9])
    for each in (B.entropy.each, B.zip_names.each):
        tracemalloc.start()
        each(batch)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 4e6
    assert B.entropy.each(batch).to_pylist()[:6] == [B.entropy_of(x) for x in odd] and B.entropy_of(b"aab") == 0.918
    assert B.zip_names.each(batch).to_pylist()[:6] == [None, None, None, None, ["a.txt", "é.txt"], None]


def test_reports_of_traces_are_cut_before_they_are_gathered(spark):
    """Thousands of events of each kind: first lines of different values, in order, and no more than a report lists."""
    lines = [f'openat(AT_FDCWD, "/home/u/f{i % 250}", O_WRONLY|O_CREAT, 0644) = 3' for i in range(1000)]
    lines += [f'unlinkat(AT_FDCWD, "/home/u/d{i // 2}", 0) = 0' for i in range(400)] + [f'renameat(AT_FDCWD, "/home/u/a{i % 3}", AT_FDCWD, "/home/u/b") = 0' for i in range(90)]
    lines += [f'fchmodat(AT_FDCWD, "/home/u/c{i}", 0{"755" if i % 2 else "644"}) = 0' for i in range(200)] + [f'memfd_create("m{i % 30}", 0) = 3' for i in range(60)]
    lines += [f'execve("/bin/p{i % 7}", ["p", "{i}"], 0x0) = 0' for i in range(130)] + ['openat(AT_FDCWD, "/etc/cron.d/z", O_WRONLY) = 3', 'fchmodat(AT_FDCWD, "/etc/cron.d/a", 0644) = 0']
    rows = [(j, i, x) for j in ("a", "b") for i, x in enumerate(lines, 1)]
    got = trace.summarize(spark.createDataFrame(rows, "job_id string, line_no long, line string")).collect()
    assert [r.job_id for r in sorted(got)] == ["a", "b"]
    for r in got:
        assert r.files_written == [f"/home/u/f{i}" for i in range(200)] and r.files_deleted == [f"/home/u/d{i}" for i in range(100)]
        assert [(x["from"], x["to"]) for x in r.files_renamed] == [(f"/home/u/a{i % 3}", "/home/u/b") for i in range(60)]
        assert [(x.path, x.makes_executable) for x in r.made_executable] == [(f"/home/u/c{i}", True) for i in range(1, 121, 2)]
        assert r.anonymous_executables == [f"m{i}" for i in range(20)] and r.trace_lines == len(lines)
        assert r.process_count == 130 and [p.path for p in r.processes] == [f"/bin/p{i % 7}" for i in range(120)]
        assert [p.path for p in r.persistence_paths] == ["/etc/cron.d/a", "/etc/cron.d/z"] and r.tcp_connects == [] and r.unix_sockets == []
