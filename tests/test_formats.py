"""PDF objects and compound files, made in awkward ways, read back; what can't be read shows as a gap."""

import io
import zipfile
import zlib

import pytest

from evidentia.engine import Engine
from evidentia.functions import binary as B
from evidentia.functions import images, ole, pdf
from tests.made_files import make_cab, make_iso, make_ole, make_pdf, pdf_text, vba_dir, vba_packed

ACTION = {"/S": "/Launch", "/F": b"tool (x).exe", "/Next": (8,)}
OBJECTS = {
    1: {"/Type": "/Catalog", "/Pages": (2,), "/OpenAction": (7,), "/Names": (10,), "/AcroForm": {"/Fields": [(16,)]}},
    2: {"/Type": "/Pages", "/Kids": [(3,), (4,), (2,)], "/Count": 3},  # a tree that comes back to itself
    3: {"/Type": "/Pages", "/Kids": [(5,), (6,)], "/Parent": (2,)},
    4: {"/Type": "/Page", "/Parent": (2,), "/#41A": {"/O": (9,)}},
    5: {"/Type": "/Page", "/Parent": (3,), "/Annots": (15,)},
    6: {"/Type": "/Page", "/Parent": (3,)},
    7: ACTION,
    8: {"/S": "/J#61vaScript", "/JS": b"app.alert('next')", "/Next": (7,)},  # actions that follow each other in a circle
    9: {"/S": "/URI", "/URI": b"http://page.example/a"},
    10: {"/JavaScript": (11,), "/EmbeddedFiles": {"/Kids": [(12,), (13,), (12,)]}},
    11: {"/Names": [b"one", {"/S": "/JavaScript", "/JS": (20,)}]},
    12: {"/Names": [b"a.exe", {"/Type": "/Filespec", "/EF": {"/F": (21,)}}]},
    13: {"/Names": [b"\xfe\xff" + "ß.txt".encode("utf-16-be"), (14,)]},
    14: {"/Type": "/Filespec", "/EF": (99,)},  # leads nowhere
    15: [{"/A": (9,)}, {"/A": {"/S": "/URI", "/URI": b"http://note.example/"}}, None or {}],
    16: {"/Kids": [(17,)]},
    17: {"/AA": {"/K": {"/S": "/JavaScript", "/JS": b"util.printf('field')"}}, "/Kids": [(16,)]},
}
STREAMS = {20: ({}, b"eval('in a stream')"), 21: ({"/Type": "/EmbeddedFile"}, b"MZ" + bytes(1000))}
LAYOUTS = {"table": {}, "packed": {"packed": True}, "lost table": {"table": False}, "lost, packed": {"table": False, "packed": True}, "after junk": {"junk": b"mail header\r\n"}}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_pdf_actions_are_found_whatever_the_layout(layout):
    got = pdf.structure(make_pdf(OBJECTS, streams=STREAMS, **LAYOUTS[layout]), B.entropy_of)
    assert got["parsed"] and got["error"] is None and got["pages"] == 3 and got["version"] == "1.7" and not got["encrypted"]
    assert sorted(got["javascript"]) == sorted(["app.alert('next')", "eval('in a stream')", "util.printf('field')"])
    assert len(got["launch_actions"]) == 1 and "tool (x).exe" in got["launch_actions"][0] and "/Launch" in got["open_action"]
    assert sorted(got["uris"]) == ["http://note.example/", "http://page.example/a"]
    assert [(a["page"], a["key"]) for a in got["page_actions"]] == [(3, "/AA")]
    assert [(f["name"], f["size"]) for f in got["embedded_files"]] == [("a.exe", 1002), ("ß.txt", None)] and got["embedded_files"][0]["entropy"] == B.entropy_of(STREAMS[21][1])


def test_a_later_update_replaces_an_object():
    old = make_pdf(OBJECTS, streams=STREAMS)
    at = len(old)
    new = old + b"9 0 obj\n" + pdf_text({"/S": "/URI", "/URI": b"http://new.example/"}) + b"\nendobj\n"
    end = len(new)
    new += b"xref\n9 1\n%010d 00000 n \ntrailer\n" % at + pdf_text({"/Size": 30, "/Root": (1,), "/Prev": int(old.rsplit(b"startxref\n", 1)[1].split()[0])}) + b"\nstartxref\n%d\n%%%%EOF" % end
    got = pdf.structure(new, B.entropy_of)
    assert sorted(got["uris"]) == ["http://new.example/", "http://note.example/"] and got["pages"] == 3
    loop = new.replace(b"/Prev ", b"/Prev %d " % end + b"/Old ")  # a chain of tables that comes back
    assert pdf.structure(loop, B.entropy_of)["uris"]


def test_pdf_tokens():
    data = rb"<< /A#20b (x\(y\)\n\101\) (in) z) /H <48 656C6c6> /N [1 -2.5 true null 3 0 R /Q] % remark" + b"\n/D<</E(e)>> >>"
    got, end = pdf.read(data, 0)
    assert got == {"/A b": b"x(y)\nA) (in) z", "/H": b"Hell`", "/N": [1, -2.5, True, None, pdf.Ref(3), "/Q"], "/D": {"/E": b"e"}} and end == len(data)
    for broken in (b"<<" * 5000, b"[" * 5000, b"(((", b"<< /A", b"", b"%PDF-1.4", b"1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj", b"xref\n0 99999999\n", b"startxref\n1\n" * 3):
        found = pdf.structure(broken, B.entropy_of)
        assert found["pages"] == 0


def test_pdf_bombs_are_cut_and_told():
    bomb = zlib.compress(bytes(80 << 20), 9)
    with pytest.raises(pdf.Broken):
        pdf.Budget(1 << 20).inflate(bomb)
    streams = {20: ({}, b"x" * 700_000), 21: ({}, bytes(700_000))}
    data = make_pdf(OBJECTS, streams=streams)
    budget = pdf.Budget(1 << 20)
    assert [len(x) for x in pdf.streams(data, budget)] == [700_000] and budget.spent
    assert pdf.structure(data, B.entropy_of, pdf.Budget(1 << 20))["error"] == "streams inflate beyond the budget"


SOURCE = b'Attribute VB_Name = "Mod1"\r\nSub AutoOpen()\r\n  Shell "calc"\r\nEnd Sub\r\n'


def project(directory=None, seed=0, **how):
    long = b'Attribute VB_Name = "Big"\r\n' + b"' filler line\r\n" * 900 + b"Function F()\r\nEnd Function\r\n"
    head = bytes(range(64)) * 3
    streams = {
        "WordDocument": bytes(5000),
        "Macros/VBA/dir": vba_packed(vba_dir([("Mod1", "Mod1", len(head)), ("Big", "Big", 7)])) if directory is None else directory,
        "Macros/VBA/Mod1": head + vba_packed(SOURCE),
        "Macros/VBA/Big": b"p-codes" + vba_packed(long),
        "Macros/PROJECT": b"ID=1",
        "Data/Deep/er/leaf": b"x" * 100,
    }
    return make_ole(streams, seed, **how), streams, long


@pytest.mark.parametrize("seed", range(6))
def test_fragmented_streams_come_back(seed):
    data, streams, long = project(seed=seed)
    file = ole.Compound(data)
    assert {p: file.stream(p) for p in file.paths} == streams
    found, error = B.vba_sources(data)
    assert error is None and [(m["stream"], m["name"]) for m in found] == [("Macros/VBA/Mod1", "Mod1"), ("Macros/VBA/Big", "Big")]
    assert found[0]["code"] == SOURCE.decode() and found[1]["code"] == long.decode()[:20000]


def test_damaged_projects_are_searched_and_loops_end():
    for broken in (b"", b"\1\xff", vba_packed(b"\x19\0\xff\xff\xff\xff")):
        found, _ = B.vba_sources(project(broken)[0])
        assert {m["stream"] for m in found} == {"Macros/VBA/Mod1", "Macros/VBA/Big"} and found[0]["code"].startswith("Attribute VB_Name")
    data, streams, _ = project(loop=True)
    file = ole.Compound(data)
    assert set(file.paths) == set(streams)
    assert file.stream("WordDocument") == streams["WordDocument"]
    for cut in range(0, len(data), 777):
        B.vba_sources(data[:cut])  # whatever is missing, it ends
    assert B.vba_sources(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(600))[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/vbaProject.bin", project()[0])
    assert [m["stream"] for m in B.vba_sources(packed.getvalue())[0]] == ["word/vbaProject.bin/Macros/VBA/Mod1", "word/vbaProject.bin/Macros/VBA/Big"]


def test_package_bombs_are_cut_and_told(monkeypatch):
    monkeypatch.setattr(B, "PART_BYTES", 1 << 20)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.rels", b"<Relationships/>")
        z.writestr("b.rels", bytes(3 << 20))
        z.writestr("c.rels", b"<never/>")
    names, parts, error = B.parts_of(packed.getvalue(), lambda n: n.endswith(".rels"))
    assert len(names) == 3 and [n for n, _ in parts] == ["a.rels"] and error == "b.rels: parts inflate beyond the budget"


def test_formats_through_the_engine_with_gaps_as_data(spark, tmp_path):
    """Parsed fields of intact files and no gap; a gap in each family's broken twin."""
    good = make_pdf(OBJECTS, streams=STREAMS, packed=True)
    doc = project()[0]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", "<w/>")
        z.writestr("word/_rels/document.xml.rels", "<Relationships/>")
    docx = packed.getvalue()
    bad_rels = docx.replace(b"<Relationships/>", b"<Relationsh1ps/>", 1)  # its checksum no longer holds
    rows = [("pdf", "a.pdf", good), ("pdf-", "a.pdf", b"%PDF-1.7 nothing here"), ("doc", "a.doc", doc), ("doc-", "a.doc", doc[:1500]), ("docx", "a.docx", docx), ("docx-", "a.docx", bad_rels)]
    files = spark.createDataFrame([(k, n, bytearray(b)) for k, n, b in rows], "job_id string, name string, content binary")
    got = {r.job_id: r for r in Engine(spark, str(tmp_path / "r")).observe(files).collect()}
    assert {k for k, r in got.items() if r.errors} == {"pdf-", "doc-", "docx-"}
    s = got["pdf"].static
    assert s.structure.pages == 3 and s.javascript_present and [f.name for f in s.structure.embedded_files] == ["a.exe", "ß.txt"] and "http://page.example/a" in s.file_iocs.urls
    assert [m.stream for m in got["doc"].static.vba.macros] == ["Macros/VBA/Mod1", "Macros/VBA/Big"] and got["doc"].static.vba.auto_exec


BOX = {"setup.exe": b"MZ" + bytes(70_000), "docs/readme.txt": b"hello", "docs/deep/ünï.bin": bytes(range(256)) * 300, "empty": b"", "last.dat": b"0123456789" * 400}


@pytest.mark.parametrize("joliet", [False, True])
def test_disc_images_list_and_hold_what_was_put_in(joliet):
    data = make_iso(BOX, joliet)
    assert {e["name"]: e["size"] for e in B.image_entries(data)} == {k: len(v) for k, v in BOX.items()} | {"docs/": 0, "docs/deep/": 0}
    assert {m["name"]: m["content"] for m in B.members(data)} == BOX
    looped = B.image_entries(make_iso(BOX, joliet, loop=True))
    assert len(looped) == 5 + 2 + 2
    for cut in range(0, len(data), 5000):
        B.members(data[:cut])


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("spare", [b"", b"reserved"])
def test_cabinets_list_and_hold_what_was_put_in(packed, spare):
    data = make_cab(BOX, packed, spare)
    assert {e["name"]: e["size"] for e in B.image_entries(data)} == {k: len(v) for k, v in BOX.items()}
    assert {m["name"]: m["content"] for m in B.members(data)} == BOX
    with pytest.raises(images.Broken):
        images.Cabinet(data).read(images.Cabinet(data).entries[0], 1000)  # beyond the budget
    for cut in range(0, len(data), 3000):
        B.members(data[:cut])
    assert [n for n, _ in images.members(data, 2, 1 << 30)] == list(BOX)[:2]
