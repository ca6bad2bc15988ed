import io
import json
import zipfile

from pyspark.sql import functions as F

from evidentia import sources
from evidentia.engine import Engine
from evidentia.operators import jobs, network, static, trace, triage
from evidentia.schemas import FLOW_FIELDS, ddl
from evidentia.streaming import flows as stream

TRACE = """execve("/bin/sh", ["sh", "x.sh"], 0x1) = 0
execve("/usr/bin/curl", ["curl", "-s", "http://x y"], 0x1) = 0
execve("/usr/bin/nope", ["nope"], 0x1) = -1 ENOENT (No such file)
connect(3<TCP:[1]>, {sa_family=AF_INET, sin_port=htons(4444), sin_addr=inet_addr("192.0.2.66")}, 16) = -1 EINPROGRESS (now)
connect(4, {sa_family=AF_UNIX, sun_path="/run/x"}, 110) = 0
openat(AT_FDCWD, "/home/u/.config/autostart/a", O_WRONLY|O_CREAT, 0644) = 3
openat(AT_FDCWD, "/proc/self/x", O_WRONLY) = 3
openat(AT_FDCWD, "/tmp/r", O_RDONLY) = 3
unlinkat(AT_FDCWD, "/tmp/a", 0) = 0
fchmodat(AT_FDCWD, "/tmp/a", 0755) = 0
renameat(AT_FDCWD, "/tmp/a", AT_FDCWD, "/tmp/b") = 0
memfd_create("x", 0) = 5"""


def test_trace(spark):
    lines = [("j", i + 1, x) for i, x in enumerate(TRACE.split("\n"))]
    df = spark.createDataFrame(lines[::-1], "job_id string, line_no long, line string").repartition(3)
    own = spark.createDataFrame([("j", ["sh", "x.sh"])], "job_id string, self_argv array<string>")
    r = trace.summarize(df, own).first()
    assert [(p.path, p.command) for p in r.processes] == [("/usr/bin/curl", "curl -s 'http://x y'")] and r.process_count == 1
    assert [(c.ip, c.port, c.failed) for c in r.tcp_connects] == [("192.0.2.66", 4444, False)]
    assert r.unix_sockets == ["/run/x"] and r.files_written == ["/home/u/.config/autostart/a"]
    assert r.files_deleted == ["/tmp/a"] and r.made_executable[0].mode == "0755" and r.anonymous_executables == ["x"]
    assert r.files_renamed[0]["to"] == "/tmp/b" and r.lolbins_invoked == ["curl"] and r.trace_lines == 12
    assert [(p.path, p.meaning) for p in r.persistence_paths] == [("/home/u/.config/autostart/a", "user autostart"), ("/tmp/a", "staging directory")]


def _flows(spark):
    rows = [("2026-01-01T00:00:00.000000+00:00", "10.0.0.2", "dns", "a.example"), ("2026-01-01T00:00:10.000000+00:00", "10.0.0.2", "dns", "b.example"), ("2026-01-01T00:00:10.000001+00:00", "10.0.0.2", "dns", "late.example"), ("2026-01-01T00:00:05.000000+00:00", "10.0.0.9", "dns", "other.example"), ("bad", "10.0.0.2", "dns", "x"), ("2026-01-01T00:00:04.000000+00:00", "10.0.0.2", "http", None)]
    return spark.createDataFrame([dict(ts=a, src=b, kind=c, qname=d, host="h.example" if c == "http" else None) for a, b, c, d in rows], ddl(FLOW_FIELDS))


def _jobs(spark):
    return spark.createDataFrame([("j", "10.0.0.2", "2026-01-01T00:00:00+00:00", "2026-01-01T00:00:10+00:00"), ("k", None, None, None)], "job_id string, worker_ip string, started_at string, finished_at string")


def test_flow_window_includes_both_ends(spark):
    got = {r.job_id: r.network for r in network.collect(_flows(spark), _jobs(spark)).collect()}
    assert [q.qname for q in got["j"].dns_queries] == ["a.example", "b.example"]
    assert got["j"].contacted_hosts == ["a.example", "b.example", "h.example"] and got["k"].dns_queries == []


def test_stream_equals_batch(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    lines = [json.dumps({k: v for k, v in r.asDict().items() if v is not None}) for r in _flows(spark).collect()]
    (log / "a.json").write_text("\n".join([*lines, "{broken"]))
    q = stream.matched(stream.read(spark, str(log)), _jobs(spark)).select("job_id", "qname", "host").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: tuple(map(str, r))
    batch = network.match(sources.flows(spark, str(log)), _jobs(spark)).select("job_id", "qname", "host").collect()
    assert sorted(spark.table("seen").collect(), key=key) == sorted(batch, key=key) and len(batch) == 3


def _zip(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            z.writestr(k.replace("__", "/").replace("_dot_", "."), v)
    return bytearray(b.getvalue())


def test_static_families(spark, tmp_path):
    inner = _zip(a_dot_scr="MZ1")
    rels = '<Relationship Id="r1" Type="http://x/attachedTemplate" Target="http://evil.example.com/t.dotm" TargetMode="External"/>'
    rows = [
        ("zip", "docs.zip", _zip(invoice_dot_pdf_dot_exe="MZ", in_dot_zip=bytes(inner))),
        ("docx", "pay.docx", _zip(word__document_dot_xml="x", word___rels__s_dot_xml_dot_rels=rels)),
        ("js", "a.js", bytearray(b'var s = "ht" + "tp://evil.example.com"; new ActiveXObject("x");' + b" " * 1200)),
        ("pdf", "a.pdf", bytearray(b"%PDF-1.4 /OpenAction << /S /JavaScript /JS (app.alert(1)) >> /Launch %%EOF")),
        ("jar", "a.jar", _zip(META_dash="", **{"META-INF__MANIFEST_dot_MF": "Main-Class: a.B\nMain-Class: c.D\n", "a__Exploit_dot_class": "x"})),
        ("txt", "a.txt", bytearray(b"hello there, nothing to see")),
        ("empty", "a.bin", bytearray(b"")),
    ]
    files = spark.createDataFrame(rows, "job_id string, name string, content binary")
    engine = Engine(spark, str(tmp_path / "reports"))
    engine.submit(files)
    got = {r.job_id: r for r in engine.reports().collect()}
    ids = {k: [s.id for s in r.signatures] for k, r in got.items()}
    assert {"ARCHIVE_DECOY_NAME", "ARCHIVE_NESTED_EXECUTABLE", "ARCHIVE_DANGEROUS_CONTENT"} <= set(ids["zip"])
    assert got["docx"].verdict.score == 84 and ids["docx"] == ["OFFICE_REMOTE_TEMPLATE", "OFFICE_EXTERNAL_REL"]
    assert {"SCRIPT_OBFUSCATED", "DANGEROUS_EXTENSION"} <= set(ids["js"]) and "evil.example.com" in got["js"].iocs.domains
    assert {"PDF_LAUNCH_ACTION", "PDF_AUTO_ACTION", "PDF_JAVASCRIPT"} <= set(ids["pdf"])
    assert "JAR_SUSPICIOUS_MANIFEST" in ids["jar"] and got["jar"].static.jar.main_class == "c.D"
    assert ids["txt"] == [] and got["empty"].verdict.level == "benign"
    assert engine.jobs(3).count() == 3 and engine.report("zip").count() == 1 and engine.rules().first().severity == 85


def test_recorded_outputs_reach_rules(spark, tmp_path):
    ole = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 600
    page = b"%PDF-1.7 1 0 obj << /Type /Pages /Count 1 >> endobj 2 0 obj << /Type/Page /AA << /O 3 0 R >> >> endobj %%EOF"
    elf = b"\x7fELF\x02\x01" + b"\0" * 10 + b"\x02\x00\x3e\x00" + b"\0" * 40
    rows = [("doc", "a.doc", ole), ("js", "a.js", b"var a = new ActiveXObject('x');"), ("ps", "a.ps1", b"Write-Host $x; param(1)"), ("pdf", "a.pdf", page), ("7z", "a.7z", bytes.fromhex("377ABCAF271C") + b"\0" * 40), ("rar", "a.rar", b"Rar!\x1a\x07\x00" + b"\0" * 40), ("elf", "a", elf), ("cut", "b", b"\x7fELF\x02\x01"), ("late", "a.txt", b"plain text here"), ("bad", "b.txt", b"plain text here")]
    files = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "job_id string, name string, content binary")
    dde = json.dumps([{"type": "dde-link", "msg": "cmd"}])
    outputs = spark.createDataFrame([("doc", dde, "see http://drop.example/a.exe now", None, None), ("js", None, None, json.dumps([{"value": {"url": "http://x.example/p"}}]), json.dumps(["http://y.example/q"]))], "job_id string, dde string, oleobj string, script_iocs string, script_urls string")
    listings = spark.createDataFrame([("7z", i, x) for i, x in enumerate(["Path = invoice.pdf.exe", "Size = 12", "Encrypted = +", "Path = d", "Attributes = D_"])], "job_id string, line_no long, line string")
    ends = spark.createDataFrame([("late", None, True, None), ("bad", "no worker", None, None)], "job_id string, error string, timed_out boolean, worker_status string")
    got = {r.job_id: r for r in Engine(spark, str(tmp_path)).analyze(files, outputs=outputs, listings=listings, job_table=ends).collect()}
    ids = {k: {s.id for s in r.signatures} for k, r in got.items()}
    assert "OFFICE_DDE" in ids["doc"] and got["doc"].static.ole_objects.found_urls == ["http://drop.example/a.exe"] and "IOC_EXECUTABLE_URL" in ids["doc"]
    assert "SCRIPT_DROPPER_BEHAVIOUR" in ids["js"] and got["js"].dynamic.extracted_urls == ["http://x.example/p", "http://y.example/q"]
    assert "PDF_AUTO_ACTION" in ids["pdf"] and [(a.page, a.key) for a in got["pdf"].static.structure.page_actions] == [(1, "/AA")] and got["pdf"].static.structure.pages == 1 and got["pdf"].static.structure.version == "1.7"
    assert {"ARCHIVE_PASSWORD_PROTECTED", "ARCHIVE_DECOY_NAME", "ARCHIVE_DANGEROUS_CONTENT"} <= ids["7z"] and got["7z"].errors == []
    assert [e.stage for e in got["rar"].errors] == ["static"] and "Analysis gaps" in got["rar"].llm_summary
    assert got["elf"].static.elf["type"] == "EXEC" and got["elf"].errors == [] and [e.stage for e in got["cut"].errors] == ["static"]
    assert (got["late"].status, got["bad"].status, got["js"].status) == ("timeout", "failed", "completed") and got["late"].verdict.confidence <= 0.4
    assert [e.stage for e in got["bad"].errors] == ["orchestrator"] and "no worker" in got["bad"].llm_summary


def test_published_scores(spark):
    """Severities of the published samples give their published scores."""
    from evidentia.operators import scoring
    from evidentia.rule_texts import RULES

    by = {r[0]: r[2] for r in RULES}
    published = [(90, "PDF_LAUNCH_ACTION PDF_AUTO_ACTION IOC_EXECUTABLE_URL PDF_JAVASCRIPT"), (84, "OFFICE_REMOTE_TEMPLATE OFFICE_EXTERNAL_REL"), (84, "OFFICE_MACRO_SHELL OFFICE_MACRO_AUTOEXEC OFFICE_MACRO_OBFUSCATED OFFICE_MACRO_PRESENT"), (85, "ARCHIVE_DECOY_NAME ARCHIVE_DANGEROUS_CONTENT ARCHIVE_CHILD_MISMATCH"), (92, "SCRIPT_DROPPER_BEHAVIOUR SCRIPT_ENCODED_PAYLOAD SCRIPT_OBFUSCATED DANGEROUS_EXTENSION"), (75, "OFFICE_EMBEDDED_EXECUTABLE")]
    df = spark.createDataFrame([(want, [by[i] for i in ids.split()]) for want, ids in published], "want int, sevs array<int>")
    assert all(r[0] == r[1] for r in df.select("want", scoring.score(F.col("sevs"))).collect())


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "j1.log").write_text("a\nb\n\nc")
    (tmp_path / "t" / "j2.log").write_text("d")
    assert sorted(map(tuple, sources.trace_lines(spark, f"{tmp_path}/t").collect())) == [("j1", 1, "a"), ("j1", 2, "b"), ("j1", 4, "c"), ("j2", 1, "d")]
    assert sorted(map(tuple, sources.trace_lines(spark, f"{tmp_path}/t", most=2).collect())) == [("j1", 1, "a"), ("j1", 2, "b"), ("j2", 1, "d")]
    f = sources.files(spark, f"{tmp_path}/t")
    ok, no = sources.accepted(f, 3)
    assert [r.name for r in ok.collect()] == ["j2.log"] and [r.code for r in no.collect()] == [413] and sources.first_sample(f.withColumn("job_id", F.lit("x"))).first().name == "j1.log"
    raw = spark.createDataFrame([('{"file": {"name": "a", "size": 3}}',), ("{broken",), (None,)], "value string")
    assert [r.file.name if r.file else None for r in sources.observations(raw).collect()] == ["a", None, None]
    sources.write(spark.range(3), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_flows_are_cut_before_they_are_gathered(spark):
    rows = [dict(ts=f"2026-01-01T00:00:{i % 10:02d}.{i:06d}+00:00", src="10.0.0.2", kind="dns", qname=f"n{i % 130}.example") for i in range(400)]
    got = network.collect(spark.createDataFrame(rows, ddl(FLOW_FIELDS)), _jobs(spark)).where("job_id = 'j'").first().network
    first = [r["qname"] for r in sorted(rows, key=lambda r: r["ts"]) if r["ts"] <= "2026-01-01T00:00:10.000000"][:120]
    assert [q.qname for q in got.dns_queries] == first and len(got.contacted_hosts) == 130


def test_family_mismatch(spark):
    df = spark.createDataFrame([("invoice.pdf", bytearray(b"MZ" + b"\0" * 80)), ("x.msg", bytearray(bytes.fromhex("D0CF11E0A1B11AE1")))], "name string, content binary")
    f = {r.name: r.file for r in triage.triage(df).collect()}
    assert f["invoice.pdf"].extension_mismatch == "content is DOS/PE executable but the filename claims '.pdf'" and f["x.msg"].family == "msg"


def test_tool_outputs(spark):
    msgs = json.dumps([{"type": "header", "msg": "DDE Links:"}, {"type": "msg", "msg": "cmd /c calc"}])
    listing = "Path = a.exe\nSize = 12\nEncrypted = +\n\nPath = d\nAttributes = D_\n"
    d = spark.createDataFrame([("junk " + msgs,), ("[]",)], "v string").select(sources.dde(F.col("v")).alias("d")).collect()
    assert d[0].d.found and d[0].d.links == ["cmd /c calc"] and not d[1].d.found
    lines = spark.createDataFrame([("j", i, x) for i, x in enumerate(listing.split("\n"))], "job_id string, line_no long, line string")
    got = {r.name: r for r in sources.listing_records(lines).collect()}
    assert got["a.exe"].encrypted and got["a.exe"]["size"] == 12 and got["d"].is_dir
    assert spark.range(1).select(static.traversal(F.lit("a\\..\\b")), static.traversal(F.lit("a/b"))).first()[:] == (True, False)


def test_jobs(spark):
    df = spark.range(5).withColumnRenamed("id", "seq")
    assert [r.seq for r in jobs.listing(df, 2).collect()] == [4, 3] and jobs.listing(df, 0).count() == 5


def test_children_of_children_in_one_pass(spark):
    """Three layers at most, each child once, ordered by layer and name; a package of Office isn't unpacked."""

    def pack(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, b in files.items():
                z.writestr(n, b)
        return out.getvalue()

    deepest = pack(lost=b"too deep")
    third = pack(c=b"MZ" + bytes(80), deepest=deepest)
    book = pack(**{"[Content_Types].xml": b"", "xl/workbook.xml": b""})
    top = pack(second=pack(third=third, b=b"plain words here", e=b""), a=b"more plain words", book=book)
    files = spark.createDataFrame([("j", bytearray(top)), ("k", bytearray(b"no archive")), ("l", None)], "job_id string, content binary")
    got = {r.job_id: [(c.depth, c.name, c.size) for c in r.children] for r in static.children(files).collect()}
    assert got == {"j": [(1, "a", 16), (1, "book", len(book)), (1, "second", len(pack(third=third, b=b"plain words here", e=b""))), (2, "b", 16), (2, "e", 0), (2, "third", len(third)), (3, "c", 82), (3, "deepest", len(deepest))]}
