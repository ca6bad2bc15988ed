"""Static observations by family: scripts, PDF, archives, Office, programs, and anything else.

Rows carry ``job_id``, ``content`` and the triage record ``file``. Each family is a branch of its own (Python functions run
for every row of their stage, so ``when`` alone would not spare the others), and branches are united by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import binary as B
from ..functions import text as X
from ..schemas import ERRORS, STATIC, STRUCTURE, ddl
from . import triage as T

SCRIPTS = ["js", "vbs", "wsf", "hta", "ps1", "bat", "sh", "py", "pl", "rb"]
OFFICE = ["ole", "ole_office", "ooxml_word", "ooxml_excel", "ooxml_powerpoint", "ooxml_other", "rtf", "msg"]
ARCHIVES = ["zip", "rar", "7z", "gzip", "bzip2", "xz", "cab", "iso", "jar"]
PROGRAMS = ["pe", "elf"]


def _static(**known: Column) -> Column:
    """The wide record with what is known; the rest null."""
    fields = {f.name: f.dataType for f in ddl(f"static:{STATIC}")[0].dataType}
    return F.struct(*[(known[k] if k in known else F.lit(None)).cast(t).alias(k) for k, t in fields.items()]).alias("static")


def _text(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def script(df: DataFrame) -> DataFrame:
    raw = F.substring("content", 1, B.OFFICE_BYTES)
    df = df.withColumn("_t", _text(raw)).withColumn("_l", X.latin1(raw))
    t = F.col("_t")
    codes = F.transform(X.found(t, r"(?i)(?:String\.)?fromCharCode\s*\(([\d\s,]+)\)"), lambda r: F.regexp_extract_all(r, F.lit(r"\d+"), F.lit(0)))
    df = df.withColumn("_codes", B.from_codes(codes)).withColumn("_blobs", B.decoded_blobs(X.base64_blobs(t))).withColumn("_entropy", B.entropies(raw))
    cap = lambda c: X.distinct(c, 40)
    built = F.struct(cap(F.col("_codes")).alias("fromcharcode"), cap(X.hex_escapes(t)).alias("hex_escapes"), cap(X.reversed_literals(t)).alias("reversed"), cap(X.joined_literals(t, "+", 60, 6)).alias("concatenated"))
    df = df.withColumn("_built", built).withColumn("_longest", X.longest_line(t))
    b = F.col("_built")
    again = F.concat_ws("\n", b["fromcharcode"], b["hex_escapes"], b["reversed"], b["concatenated"], F.lit(""), F.transform(F.filter("_blobs", lambda x: x["looks_like_text"]), lambda x: x["decoded_preview"]))
    here, there = X.iocs(F.col("_l")), X.iocs(X.latin1(again.cast("binary")))
    both = F.struct(*[F.array_union(here[k], there[k]).alias(k) for k in ("urls", "domains", "ips", "emails")])
    powershell = F.when(F.col("file.family").isin("ps1", "bat"), X.keyword_meanings(t, dims.POWERSHELL_RISK, "flag"))
    return df.withColumn("static", _static(engine=F.lit("script"), deobfuscated=b, base64_blobs=F.col("_blobs"), longest_line=F.col("_longest"), single_line_obfuscation=F.col("_longest") > 1000, line_count=X.line_count(t), length=F.length(t), entropy=F.col("_entropy"), powershell_indicators=powershell, file_iocs=both)).drop("_t", "_l", "_codes", "_blobs", "_entropy", "_built", "_longest")


_JS = r"(?i)(?<![A-Za-z0-9_])(eval|unescape|app\.|this\.exportDataObject|util\.print[df]|String\.fromCharCode|Collab\.)"


def _pdf_patterns(every: Column, raw: Column) -> dict[str, Column]:
    """What patterns find in a document that has no readable objects."""
    literal = r"\(((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)"  # with one level of balanced parentheses
    opened = r"(?s)/OpenAction\s*(<<.{0,400}?>>|\d+\s+\d+\s+R|\[[^\]]{0,200}\])"
    return {
        "version": F.regexp_extract(raw, r"^%PDF-(\d+\.\d+)", 1),
        "encrypted": raw.rlike(r"/Encrypt(?![A-Za-z])"),
        "javascript": X.found(every, rf"(?s)/JS\s*{literal}"),
        "open_action": F.nullif(F.regexp_extract(every, opened, 1), F.lit("")),
        "launch_actions": X.found(every, r"(?s)(/S\s*/Launch.{0,300}?)(?:>>|endobj)"),
        "uris": X.distinct(X.found(every, rf"/URI\s*{literal}"), 100),
    }


def pdf(df: DataFrame) -> DataFrame:
    df = df.withColumn("_f", B.pdf_facts(F.col("content"))).withColumn("_raw", X.latin1(F.substring("content", 1, B.PDF_BYTES)))
    df = df.withColumn("_all", F.concat(F.col("_raw"), F.lit("\n"), F.array_join("_f.streams", "\n")))
    every, read, streams = F.col("_all"), F.col("_f.structure"), F.col("_f.streams")
    spare = _pdf_patterns(every, F.col("_raw"))
    fields = [f.name for f in ddl(f"s:{STRUCTURE}")[0].dataType]
    df = df.withColumn("_s", F.struct(*[(F.when(read["parsed"], read[k]).otherwise(spare[k]) if k in spare else read[k]).alias(k) for k in fields]))
    said = F.transform(F.filter(streams, lambda s: s.rlike(_JS)), lambda s: X.truncate(s, 8000))
    df = df.withColumn("_js", X.distinct(F.concat(F.coalesce("_s.javascript", F.array().cast("array<string>")), said), 20))
    found = X.iocs(every)
    urls = F.array_union(found["urls"], F.coalesce("_s.uris", F.array().cast("array<string>")))
    linked = F.struct(urls.alias("urls"), *[found[k].alias(k) for k in ("domains", "ips", "emails")])
    known = _static(
        engine=F.lit("pdf"),
        structure=F.col("_s"),
        keywords=X.keyword_counts(every, dims.PDF_KEYWORDS),
        object_streams_inflated=F.size(streams),
        javascript=F.col("_js"),
        javascript_present=F.size("_js") > 0,
        incremental_updates=F.greatest(F.lit(0), X.count_of(F.col("_raw"), "%%EOF") - 1),
        file_iocs=linked,
    )
    return df.withColumn("static", known).withColumn("errors", _told("pdf", F.col("_f.error"))).drop("_f", "_raw", "_all", "_s", "_js")


def traversal(name: Column) -> Column:
    """A path that leaves the folder it is unpacked to."""
    plain = F.translate(name, "\\", "/")
    return F.startswith(plain, F.lit("/")) | F.array_contains(F.split(plain, "/"), "..")


def children(df: DataFrame, depth: int = B.MOST_DEPTH) -> DataFrame:
    """(job_id, children) of archives: members triaged layer by layer, three at most, 180 in all.

    One pass: a row is a file still to be judged, or a child that is. Judging a file that is an archive itself gives the
    child and a row for each of its members, so no layer is unpacked twice.
    """
    f = F.col("file")
    child = F.struct(f["name"].alias("name"), F.col("depth").alias("depth"), f["family"].alias("family"), f["label"].alias("label"), f["size"].alias("size"), f["sha256"].alias("sha256"), f["entropy"].alias("entropy"), f["extension_mismatch"].alias("extension_mismatch"), f["filename_flags"].alias("filename_flags"), f["extension_is_dangerous"].alias("dangerous"))
    rows = df.select("job_id", F.explode(B.archive_members(F.col("content"))).alias("m")).select("job_id", "m.name", F.coalesce("m.content", F.lit(b"")).alias("content"), F.lit(1).alias("depth"), F.lit(None).alias("c"))
    for d in range(1, depth + 1):
        seen = T.triage(rows).withColumn("c", F.coalesce("c", child))
        if d < depth:
            inner = B.archive_members(F.when((F.col("depth") == d) & f["family"].isin(ARCHIVES), F.col("content")))
            judged = F.struct(F.lit("").alias("name"), F.lit(b"").alias("content"), F.col("depth"), F.col("c"))
            fresh = F.transform("_inner", lambda m: F.struct(m["name"].alias("name"), m["content"].alias("content"), F.lit(d + 1).alias("depth"), F.when(F.lit(False), F.col("c")).alias("c")))
            rows = seen.withColumn("_inner", inner).select("job_id", F.explode(F.concat(F.array(judged), fresh)).alias("r")).select("job_id", "r.*")
    order = lambda a, b: F.when(a["depth"] != b["depth"], a["depth"] - b["depth"]).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    return seen.groupBy("job_id").agg(F.slice(F.array_sort(F.collect_list("c"), order), 1, B.MOST_CHILDREN * depth).alias("children"))


def child_facts(children: Column) -> tuple[Column, Column, Column]:
    """(deepest layer, whether any child runs, whether one below the first layer does); 0 and false without children."""
    runs = lambda c: F.coalesce(c["family"].isin("pe", "elf"), F.lit(False)) | F.coalesce(c["dangerous"], F.lit(False))
    some = lambda f: F.coalesce(F.exists(children, f), F.lit(False))
    return F.coalesce(F.array_max(F.transform(children, lambda c: c["depth"])), F.lit(0)), some(runs), some(lambda c: runs(c) & (c["depth"] >= 2))


def listing_facts(entries: Column, format: Column) -> dict[str, Column]:
    files = F.filter(entries, lambda e: ~e["is_dir"])
    total = F.aggregate(files, F.lit(0).cast("long"), lambda a, e: a + F.coalesce(e["size"], F.lit(0)))
    packed = F.aggregate(files, F.lit(0).cast("long"), lambda a, e: a + F.greatest(e["compressed"], F.lit(1)))
    ratio = F.when(F.exists(entries, lambda e: e["compressed"].isNotNull()), F.bround(total / F.greatest(packed, F.lit(1)), 1))
    danger = F.filter(files, lambda e: e["extension"].isin(dims.DANGEROUS_EXTS))
    dots = lambda n: F.length(n) - F.length(F.replace(n, F.lit("."), F.lit("")))
    decoy = F.transform(files, lambda e: F.struct(e["name"].alias("name"), F.when(F.contains(e["name"], F.lit(T.RLO)), "right-to-left override character").when(e["extension"].isin(dims.DANGEROUS_EXTS) & (dots(T.safe_name(e["name"])) >= 2), "double extension hiding an executable").alias("reason")))
    encrypted = F.exists(entries, lambda e: e["encrypted"])
    return {
        "listing": F.struct(format.alias("format"), encrypted.alias("encrypted"), ratio.alias("compression_ratio"), total.alias("total_uncompressed"), F.size(entries).alias("entry_count")),
        "entries": entries,
        "dangerous_entries": F.transform(danger, lambda e: F.struct(e["name"].alias("name"), e["extension"].alias("extension"))),
        "decoy_names": F.filter(decoy, lambda d: d["reason"].isNotNull()),
        "password_protected": encrypted,
        "path_traversal": F.transform(F.filter(entries, lambda e: traversal(e["name"])), lambda e: e["name"]),
        "zip_bomb_suspected": F.coalesce(ratio > B.BOMB_RATIO, F.lit(False)),
    }


def jar(names: Column, manifest: Column) -> Column:
    """Manifest (the last value of a key counts), class names with telling words, signature."""
    pairs = F.transform(F.filter(F.split(manifest, "\\r\\n|\\n|\\r"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["key"] == p["key"]))
    classes = F.filter(names, lambda n: F.endswith(F.lower(n), F.lit(".class")))
    odd = F.transform(classes, lambda c: F.struct(c.alias("class"), F.array_sort(F.filter(X.array_of(dims.JAR_KEYWORDS), lambda k: F.contains(F.regexp_replace(F.lower(F.substring_index(c, "/", -1)), r"\.[^.]*$", ""), k))).alias("matched_keywords")))
    m = F.map_from_entries(last)
    return F.when(names.isNotNull(), F.struct(m.alias("manifest"), F.try_element_at(m, F.lit("Main-Class")).alias("main_class"), F.size(classes).alias("class_count"), F.filter(odd, lambda o: F.size(o["matched_keywords"]) > 0).alias("suspicious_class_names"), F.exists(names, lambda n: F.upper(n).rlike(r"^META-INF/.*\.SF$")).alias("signed")))


def _gap(stage: str, missing: Column, said: str) -> Column:
    """A stage that failed, as data: what can't be read must not look clean."""
    return F.when(F.coalesce(missing, F.lit(False)), F.array(F.struct(F.lit(stage).alias("stage"), F.lit(said).alias("error")))).otherwise(F.array().cast(ERRORS)).alias("errors")


def _told(stage: str, *said: Column) -> Column:
    """Stages that failed, by what their readers say; null says nothing."""
    rows = F.array(*[F.when(s.isNotNull(), F.struct(F.lit(stage).alias("stage"), s.alias("error"))) for s in said])
    return F.filter(rows, lambda r: r.isNotNull()).cast(ERRORS)


def archive(df: DataFrame, listings: DataFrame | None = None) -> DataFrame:
    """``listings`` (job_id, name, size, encrypted, is_dir): entries that an archiver listed, for formats that aren't read here."""
    kids = children(df)
    df = df.withColumn("_e", B.archive_entries(F.col("content"))).withColumn("_j", B.jar_parts(F.when(F.col("file.family") == "jar", F.col("content"))))
    df = df.join(kids, "job_id", "left")
    if listings is not None:
        row = {"name": F.col("name"), "size": F.col("size"), "encrypted": F.coalesce("encrypted", F.lit(False)), "extension": T.extension(F.translate("name", "\\", "/")), "is_dir": F.coalesce("is_dir", F.lit(False)), "is_link": F.lit(False)}
        told = listings.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(*[row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ddl(f"e:{B.ENTRIES}")[0].dataType.elementType]))).alias("_told"))
        df = df.join(told, "job_id", "left").withColumn("_e", F.coalesce("_e", "_told")).drop("_told")
    # A compressed file alone has one member and no listing.
    df = df.withColumn("errors", _gap("static", F.col("_e").isNull() & F.col("children").isNull(), "the archive could not be listed")).withColumn("_e", F.coalesce("_e", F.array().cast(B.ENTRIES)))
    df = df.withColumn("errors", F.concat("errors", _told("jar", F.col("_j.error"))))
    facts = listing_facts(F.col("_e"), F.col("file.family"))
    depth, _, _ = child_facts(F.col("children"))
    return df.withColumn("static", _static(engine=F.lit("archive"), **facts, children=F.col("children"), max_depth=depth, jar=jar(F.col("_j.names"), F.col("_j.manifest")))).drop("_e", "_j", "children")


def relationships(rels: Column) -> Column:
    """External targets of a package; attributes in the order Id, Type, Target, judged by the target's scheme."""
    pattern = r'<Relationship\b[^>]*?Id="([^"]*)"[^>]*?Type="([^"]*)"[^>]*?Target="([^"]*)"'
    rows = F.flatten(F.transform(rels, lambda r: F.transform(F.arrays_zip(F.regexp_extract_all(r["xml"], F.lit(pattern), F.lit(2)).alias("t"), F.regexp_extract_all(r["xml"], F.lit(pattern), F.lit(3)).alias("g")), lambda z: F.struct(r["part"].alias("part"), z["t"].alias("full"), z["g"].alias("target")))))
    return F.filter(rows, lambda x: F.lower(x["target"]).rlike(r"^(https?://|ftp://|file://|\\\\|mhtml:)"))


def office(df: DataFrame) -> DataFrame:
    raw = F.substring("content", 1, B.OFFICE_BYTES)
    c = F.col("content")
    df = df.withColumn("_v", B.vba_macros(c)).withColumn("_q", B.package_rels(c))
    df = df.withColumn("_m", F.col("_v.macros")).withColumn("_r", F.col("_q.rels")).withColumn("_p", B.embedded_executables(c)).withColumn("_x", B.xlm_sheets(F.when(F.col("file.family").isin("ole", "ole_office"), c))).withColumn("_n", B.archive_entries(F.when(F.col("file.family").like("ooxml%"), c))).withColumn("_l", X.latin1(raw))
    code = F.array_join(F.transform("_m", lambda m: m["code"]), "\n")
    df = df.withColumn("_c", code).withColumn("_ext", relationships(F.col("_r")))
    code, ext, n = F.col("_c"), F.col("_ext"), F.coalesce(F.col("_n"), F.array().cast(B.ENTRIES))
    runs = F.transform(X.found(code, r"(?i)((?:Chr[W$]?\s*\(\s*\d{1,7}\s*\)\s*&?\s*){3,})"), lambda r: F.regexp_extract_all(r, F.lit(r"\d+"), F.lit(0)))
    df = df.withColumn("_k", B.from_codes(runs))
    shown = F.filter("_k", lambda s: ~s.rlike(r"\p{C}"))
    vba = F.struct(F.col("_m").alias("macros"), X.auto_exec(code).alias("auto_exec"), X.keyword_meanings(code, dims.SUSPICIOUS_VBA).alias("suspicious_calls"), F.aggregate("_m", F.lit(0), lambda a, m: a + m["lines"]).alias("total_macro_lines"), X.distinct(F.concat(shown, X.str_reverse(code), X.joined_literals(code, "&", 80, 8)), 60).alias("deobfuscated"), X.iocs(X.latin1(code.cast("binary"))).alias("raw_iocs"))
    template = F.filter(ext, lambda e: F.endswith(e["full"], F.lit("/attachedTemplate")))
    package = F.when(
        F.col("_n").isNotNull(),
        F.struct(
            F.transform(n, lambda e: F.struct(e["name"].alias("name"), e["size"].alias("size"), e["compressed"].alias("compressed"))).alias("entries"),
            F.transform(ext, lambda e: F.struct(e["part"].alias("part"), F.substring_index(e["full"], "/", -1).alias("type"), e["target"].alias("target"))).alias("external_targets"),
            F.get(template, F.size(template) - 1)["target"].alias("remote_template"),
            F.transform(F.filter(n, lambda e: F.lower(e["name"]).rlike("/embeddings/|/oleobject")), lambda e: e["name"]).alias("embedded_objects"),
            F.exists(n, lambda e: F.endswith(F.lower(e["name"]), F.lit("vbaproject.bin"))).alias("has_vba_project"),
        ),
    )
    xlm = (F.col("file.family").isin("ole_office", "ooxml_excel") & F.col("_l").rlike(r"(?i)Excel 4\.0|xlm(?:macro|sheet)|macrosheets/")) | (F.size("_x") > 0)
    return df.withColumn("static", _static(engine=F.lit("office"), vba=vba, package=package, xlm_biff8_sheets=F.col("_x"), xlm_macros_indicated=xlm, embedded_executables=F.col("_p"), file_iocs=X.iocs(F.col("_l")))).withColumn("errors", _gap("static", F.col("file.family").like("ooxml%") & F.col("_n").isNull(), "the package could not be read")).withColumn("errors", F.concat("errors", _told("vba", F.col("_v.error")), _told("package", F.col("_q.error")))).drop("_v", "_q", "_m", "_r", "_p", "_x", "_n", "_l", "_c", "_ext", "_k")


def program(df: DataFrame, as_of: int | None = None) -> DataFrame:
    raw = F.substring("content", 1, B.PE_BYTES)
    df = df.withColumn("_pe", B.pe_facts(F.when(F.col("file.family") == "pe", F.col("content")))).withColumn("_l", X.latin1(raw))
    p = F.col("_pe")
    at, odd = B.compile_time(p["timestamp"], F.lit(as_of if as_of is not None else B.now_seconds()))
    packers = F.filter(F.transform(p["sections"], lambda s: F.try_element_at(F.create_map(*[F.lit(x) for kv in dims.PACKER_SECTIONS.items() for x in kv]), F.lower(s["name"]))), lambda x: x.isNotNull())
    pe = F.when(F.col("file.family") == "pe", F.struct(p["parsed"].alias("parsed"), p["sections"].alias("sections"), F.array_sort(F.array_distinct(packers)).alias("packer_sections"), p["imports"].alias("imports"), B.capabilities(p["imports"]).alias("capabilities"), p["import_table_stripped"].alias("import_table_stripped"), p["resources"].alias("resources"), p["overlay"].alias("overlay"), p["digitally_signed"].alias("digitally_signed"), odd.alias("timestamp_implausible"), at.alias("compile_time"), p["imphash"].alias("imphash"), p["entry_outside_code"].alias("entry_outside_code")))
    return df.withColumn("static", _static(engine=F.lit("pe"), pe=pe, elf=T.elf_header(F.col("content")), strings=X.strings(F.col("_l")), file_iocs=X.iocs(F.col("_l")))).withColumn("errors", _gap("static", (F.col("file.family") == "pe") & ~F.coalesce(p["parsed"], F.lit(False)) | ~F.coalesce(F.col("static.elf.parsed"), F.lit(True)), "the program's headers could not be read")).drop("_pe", "_l")


def generic(df: DataFrame) -> DataFrame:
    raw = F.substring("content", 1, B.OFFICE_BYTES)
    df = df.withColumn("_l", X.latin1(raw)).withColumn("_e", B.entropy(raw))
    return df.withColumn("static", _static(engine=F.lit("generic"), entropy=F.col("_e"), strings=X.strings(F.col("_l"), limit=200), file_iocs=X.iocs(F.col("_l")))).drop("_l", "_e")


BRANCHES = [(SCRIPTS, script), (["pdf"], pdf), (ARCHIVES, archive), (OFFICE, office), (PROGRAMS, program)]


def analyze(files: DataFrame, listings: DataFrame | None = None) -> DataFrame:
    """``files`` (job_id, content, file) plus ``static`` and ``errors``, the stages that failed."""
    family = F.col("file.family")
    files = files.withColumn("errors", F.array().cast(ERRORS))
    routed = [fn(files.where(family.isin(fams)), *([listings] if fn is archive else [])) for fams, fn in BRANCHES]
    every = [f for fams, _ in BRANCHES for f in fams]
    return reduce(DataFrame.unionByName, [*routed, generic(files.where(~F.coalesce(family, F.lit("")).isin(every)))])
