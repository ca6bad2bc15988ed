import math

import pytest
from pyspark.sql import functions as F

from evidentia.functions import binary as B
from evidentia.functions import text as X
from evidentia.operators import triage


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first()[0]


def test_indicators_keep_order_and_drop_benign(spark):
    got = one(spark, "see http://evil.example.com/x, a@b.example.org 198.51.100.7 8.8.8.8 schemas.microsoft.com HTTP://b.example.net/y. 198.51.100.7", lambda v: X.iocs(X.latin1(v.cast("binary"))))
    assert got.urls == ["http://evil.example.com/x", "HTTP://b.example.net/y"]
    assert got.ips == ["198.51.100.7"]
    assert got.emails == ["a@b.example.org"]
    assert "schemas.microsoft.com" not in got.domains and got.domains[0] == "evil.example.com"


def test_word_boundary_is_ascii(spark):
    assert one(spark, "ñevil.com", lambda v: X.domains(X.latin1(v.cast("binary")))) == ["evil.com"]


@pytest.mark.parametrize("said, want", [("http://evil.example.com/x", "hxxp://evil[.]example[.]com/x"), ("192.0.2.1", "192[.]0[.]2[.]1"), ("http://192.0.2.1/a.b", "hxxp://192[.]0[.]2[.]1/a.b"), ("ftp://a.example/x.y", "fxp://a[.]example/x.y"), ("example.com", "example.com")])
def test_defang(spark, said, want):
    assert one(spark, said, X.defang) == want


def test_defang_host(spark):
    assert one(spark, "a.b.example", X.defang_host) == "a.b[.]example"
    assert one(spark, "192.0.2.1", X.defang_host) == "192[.]0[.]2[.]1"


def test_entropy(spark):
    assert one(spark, "a" * 1000, B.letter_entropy) < 0.1
    assert one(spark, "", B.letter_entropy) == 0.0
    assert one(spark, "abcd", B.letter_entropy) == 2.0
    assert one(spark, "".join(map(chr, range(0x4E00, 0x5000))) * 3, B.letter_entropy) == 9.0
    assert B.entropy_of(bytes(range(256)) * 4) == 8.0


def test_deobfuscation(spark):
    assert one(spark, '"ht" + "tp://" + "x"', lambda v: X.joined_literals(v, "+", 60, 6)) == ["http://x"]
    assert one(spark, '"nohtyp".split("").reverse()', X.reversed_literals) == ["python"]
    assert one(spark, r'"\x41\x42\x43\x44"', X.hex_escapes) == ["ABCD"]
    assert one(spark, 'StrReverse("dlrow")', X.str_reverse) == ["world"]


def test_base64_prefers_the_printable_reading(spark):
    import base64

    said = [b"run this, then that, then this again", "a tie is utf-8, as both are whole".encode("utf-16-le"), "żółć gęślą jaźń".encode("utf-16-le"), bytes(range(200, 256)) * 2, b"MZ" + b"\0" * 60]
    blobs = [base64.b64encode(x).decode().rstrip("=") for x in said]
    df = spark.createDataFrame([(["A" * 41, "AAAA", *blobs],), (None,), ([],)], "b array<string>")
    got = [r[0] for r in df.select(B.decoded_blobs(F.col("b"))).collect()]
    assert got[1] in (None, []) and got[2] == [] and [x.encoded_length for x in got[0]] == [len(b) for b in blobs]

    def brute(raw):
        wide, narrow = raw.decode("utf-16-le", "replace"), raw.decode("utf-8", "replace")
        seen = lambda t: sum(c.isprintable() for c in t)
        return (wide, "utf-16-le") if seen(wide) > seen(narrow) else (narrow, "utf-8")

    for x, raw in zip(got[0], said):
        text, name = brute(raw)
        share = sum(c.isprintable() or c in "\r\n\t" for c in text) / len(text)
        assert (x.encoding, x.looks_like_text, x.looks_like_pe, x.decoded_preview) == (name, share > 0.85, raw[:2] == b"MZ", text if share > 0.5 else raw.hex())


def test_embedded_programs():
    pe = b"MZ" + b"\0" * 58 + (64).to_bytes(4, "little") + b"PE\0\0\x4c\x01"
    assert B.embedded_pe(b"xMZ" + pe + b"MZ" + pe) == [{"offset": 3, "machine_bytes": "4c01"}, {"offset": 75, "machine_bytes": "4c01"}]
    assert B.embedded_pe(b"") == B.embedded_pe(b"MZ" * 40) == [] and len(B.embedded_pe(pe * 12)) == 10


def test_defang_links(spark):
    for value, want in [("see http://a.b.example/x.y and https://c.example:80/", "see hxxp://a[.]b[.]example/x.y and hxxps://c[.]example:80/"), ("HTTP://A.B/c.d", "HTTP://A[.]B/c.d"), ("ftp://f.g 1.2.3.4", "fxp://f[.]g 1[.]2[.]3[.]4"), ("xhttp://a.b", "xhttp://a.b"), ("no link. here", "no link. here"), ("file://a.b/ http://", "file://a.b/ hxxp://"), ("", "")]:
        assert one(spark, value, X.defang) == want, value


def test_strings_then_wide_strings(spark):
    df = spark.createDataFrame([(bytearray(b"\x00abcdef\x01" + "widestr".encode("utf-16-le") + b"\xff"),)], "v binary")
    assert df.select(X.strings(X.latin1("v"))).first()[0] == ["abcdef", "widestr"]


@pytest.mark.parametrize("name, ext", [("a.pdf", ".pdf"), ("a.tar.GZ", ".gz"), (".bashrc", ""), ("a", ""), ("d.x/f", ""), ("..a.b", ".b")])
def test_extension(spark, name, ext):
    assert one(spark, name, triage.extension) == ext


def test_name_flags(spark):
    assert len(one(spark, "invoice‮gpj.exe", triage.name_flags)) == 1
    assert one(spark, "scan.pdf.exe", triage.name_flags) == ["double extension in filename"]
    assert one(spark, "plain.txt", triage.name_flags) == []


def test_remote_ip(spark):
    for ip, want in [("45.1.2.3", True), ("10.0.0.1", False), ("172.20.0.1", False), ("192.0.2.66", False), ("1.9.1.1", False), ("999", False)]:
        assert one(spark, ip, X.is_remote_ip) is want


def test_biff_and_vba_round_trip():
    record = b"\x85\x00" + (8 + 5).to_bytes(2, "little") + b"\0\0\0\0" + b"\x01\x01" + b"\x05\x00" + b"Macro"
    assert B.biff_sheets(b"xx" + record) == [{"name": "Macro", "type": "xlm_macro", "visibility": "hidden", "hidden": True}]
    odd = b"\x85\x00" + (8 + 5).to_bytes(2, "little") + b"\0\0\0\0" + b"\x02\x01" + b"\x09\x01" + b"Macro"
    assert B.biff_sheets(b"xx" + odd) == [{"name": "(sheet at offset 2)", "type": "xlm_macro", "visibility": "very_hidden", "hidden": True}]
    text = b"#aaabcdefaaaaghijaaaaaklaaamnopqaaaaaaaaaaaarstuvwxyzaaa"
    assert B.vba_decompress(b"\x01" + (0x3000 | 4095).to_bytes(2, "little") + text.ljust(4096, b" ")).startswith(text)


def test_pe_header(spark):
    import struct

    opt = struct.pack("<H", 0x10B) + b"\0" * 14 + struct.pack("<I", 0x1000) + b"\0" * 72 + struct.pack("<I", 0)
    head = b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 5, 0, 0, len(opt), 0) + opt
    sec = struct.pack("<8sIIIIIIHHI", b"UPX0", 0x1000, 0x1000, 16, 512, 0, 0, 0, 0, 0xE0000000)
    data = (head + sec).ljust(512, b"\0") + b"A" * 16 + b"MZoverlay"
    got = B.parse_pe(data)
    assert got["parsed"] and got["sections"][0]["write_and_execute"] and got["overlay"]["looks_executable"] and not got["digitally_signed"]
    assert B.parse_pe(b"MZ")["parsed"] is False
    df = spark.createDataFrame([(bytearray(data),), (bytearray(b"MZ"),)], "c binary")
    assert [r[0] for r in df.select(triage.is_pe(F.col("c"))).collect()] == [True, False]
    assert math.isclose(B.entropy_of(b""), 0.0)


def test_elf_header(spark):
    data = b"\x7fELF\x02\x01" + b"\0" * 10 + b"\x03\x00\x3e\x00"
    df = spark.createDataFrame([(bytearray(data),), (bytearray(b"MZ"),)], "c binary")
    got = [r[0] for r in df.select(triage.elf_header(F.col("c"))).collect()]
    assert got[0].asDict() == {"parsed": True, "class": "ELF64", "endian": "little", "type": "DYN/PIE", "machine": 62} and got[1] is None
