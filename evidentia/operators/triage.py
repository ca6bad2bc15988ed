"""What a file is: type by content, disagreement with its name, hashes. Rows have ``name`` and ``content``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import binary as B
from ..functions import text as X

HEAD = 65_536
RLO = "‮"


def safe_name(name: Column) -> Column:
    """A declared name without its folders and odd characters, at most 120 long."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)$", 1)
    kept = F.substring(F.regexp_replace(base, r"[^\p{L}\p{N}._\- ]", ""), 1, 120)
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("sample.bin"))


def extension(name: Column) -> Column:
    """From the last dot of the base name on, lower-cased; none if only dots stand before it."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1))


def magic(content: Column) -> tuple[Column, Column]:
    """(family, label) by the first signature that matches."""
    family = label = None
    for sig, at, fam, lab in dims.MAGIC:
        hit = F.substring(content, at + 1, len(sig) // 2) == F.unhex(F.lit(sig))
        family = F.when(hit, fam) if family is None else family.when(hit, fam)
        label = F.when(hit, lab) if label is None else label.when(hit, lab)
    return family, label


def package_kind(names: Column) -> tuple[Column, Column]:
    """(family, label) of a zip by the names in it; null names for one that can't be read."""
    starts = lambda p: F.exists(names, lambda n: F.startswith(n, F.lit(p)))
    macro = F.when(F.exists(names, lambda n: F.endswith(F.lower(n), F.lit("vbaproject.bin"))), " with VBA project").otherwise("")
    family = F.when(starts("word/"), "ooxml_word").when(starts("xl/"), "ooxml_excel").when(starts("ppt/"), "ooxml_powerpoint").when(F.array_contains(names, "META-INF/MANIFEST.MF"), "jar").when(F.array_contains(names, "[Content_Types].xml"), "ooxml_other").otherwise("zip")
    office = F.when(family == "ooxml_word", "Word").when(family == "ooxml_excel", "Excel").when(family == "ooxml_powerpoint", "PowerPoint").otherwise("Office")
    return family, F.when(family == "jar", F.lit("Java archive")).when(family == "zip", F.lit("ZIP container")).otherwise(F.concat(F.lit("OOXML "), office, F.lit(" document"), macro))


def is_pe(content: Column) -> Column:
    """MZ, and PE\\0\\0 where the header's pointer says, within the first 4 KiB."""
    le = F.conv(F.concat(*[F.hex(F.substring(content, 60 + k, 1)) for k in (4, 3, 2, 1)]), 16, 10).cast("long")
    return F.coalesce((F.substring(content, 1, 2) == F.unhex(F.lit("4D5A"))) & (le < 4092) & (F.substr(content, (le + 1).cast("int"), F.lit(4)) == F.unhex(F.lit("50450000"))), F.lit(False))


def elf_header(content: Column) -> Column:
    """(parsed, class, endian, type, machine) of an ELF file; null for anything else."""
    little = F.substring(content, 6, 1) == F.unhex(F.lit("01"))
    byte = lambda k: F.hex(F.substring(content, k + 1, 1))
    number = lambda at: F.conv(F.when(little, F.concat(byte(at + 1), byte(at))).otherwise(F.concat(byte(at), byte(at + 1))), 16, 10).cast("int")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in dims.ELF_TYPES.items() for x in kv]), number(16)), number(16).cast("string"))
    whole = F.octet_length(content) >= 20
    bits = F.when(F.substring(content, 5, 1) == F.unhex(F.lit("02")), "ELF64").otherwise("ELF32")
    said = lambda c: F.when(whole, c)
    return F.when(F.substring(content, 1, 4) == F.unhex(F.lit("7F454C46")), F.struct(whole.alias("parsed"), said(bits).alias("class"), said(F.when(little, "little").otherwise("big")).alias("endian"), said(kind).alias("type"), said(number(18)).alias("machine")))


def mismatch(family: Column, label: Column, ext: Column) -> Column:
    known, ok = F.lit(False), F.lit(False)
    for fam, exts in dims.EXPECTED_EXTS.items():
        known = known | (family == fam)
        ok = ok | ((family == fam) & ext.isin(exts))
    return F.when(known & (ext != "") & ~ok, F.concat(F.lit("content is "), label, F.lit(" but the filename claims '"), ext, F.lit("'")))


def name_flags(name: Column) -> Column:
    spaces = F.length(F.regexp_replace(name, r"(?U)\S", ""))
    return F.array_compact(
        F.array(
            F.when(F.contains(name, F.lit(RLO)), "filename contains a right-to-left override character, which hides the real extension from the user"),
            F.when(name.rlike(r"(?iU)\.(jpg|jpeg|png|gif|pdf|doc|docx|xls|xlsx|txt|mp4)\s*\.\w+$"), "double extension in filename"),
            F.when((spaces > 12) | F.contains(name, F.lit(" " * 8)), "long whitespace run in filename, used to push the real extension out of view"),
        )
    )


def triage(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """``files`` plus ``file``, the triage record. Zip listings and byte entropies take Arrow batches; the rest is SQL."""
    c, n = F.col(content), F.coalesce(F.col(name), F.lit(""))
    head = F.substring(c, 1, HEAD)
    family, label = magic(c)
    df = files.withColumn("_family", F.coalesce(family, F.lit("unknown"))).withColumn("_label", F.coalesce(label, F.lit("unknown")))
    # Python functions run for every row of their stage, so only zips have bytes to list.
    df = df.withColumn("_names", B.zip_names(F.when(F.col("_family") == "zip", c))).withColumn("_entropy", B.entropy(head))
    df = df.withColumn("_latin", X.latin1(head)).withColumn("_ext", extension(n))
    zf, zl = package_kind(F.col("_names"))
    ext, fam = F.col("_ext"), F.col("_family")
    textual = (fam == "unknown") & X.is_text(F.col("_latin"))
    script = X.script_language(F.make_valid_utf8(F.substring(c, 1, 4096).cast("string")))
    by_ext = F.try_element_at(F.create_map(*[F.lit(x) for kv in dims.SCRIPT_EXTS.items() for x in kv]), ext)
    zipped = (fam == "zip") & F.col("_names").isNotNull()
    ole = F.when(ext == ".msg", "msg").when(ext.isin(dims.OFFICE_EXTS) | (ext == ""), "ole_office")
    df = df.withColumn("_script", F.when(textual, script)).withColumn("_by_ext", F.when(textual, by_ext))
    s, e = F.col("_script"), F.col("_by_ext")
    family = F.when(zipped, zf).when(textual, F.coalesce(s, e, F.lit("text"))).when(fam == "ole", F.coalesce(ole, fam)).otherwise(fam)
    label = (
        F.when(zipped, zl)
        .when(fam == "zip", "ZIP container")
        .when(textual, F.coalesce(F.concat(s, F.lit(" script (by content)")), F.concat(e, F.lit(" script (by extension)")), F.lit("plain text")))
        .when((fam == "ole") & (ole == "msg"), "Outlook message")
        .when((fam == "ole") & (ole == "ole_office"), "Legacy OLE Office document")
        .otherwise(F.col("_label"))
    )
    df = df.withColumn("_f", family).withColumn("_l", label)
    record = F.struct(
        n.alias("name"), F.octet_length(c).cast("long").alias("size"), F.col("_f").alias("family"), F.col("_l").alias("label"), ext.alias("extension"),
        mismatch(F.col("_f"), F.col("_l"), ext).alias("extension_mismatch"), ext.isin(dims.DANGEROUS_EXTS).alias("extension_is_dangerous"), name_flags(n).alias("filename_flags"),
        F.col("_entropy").alias("entropy"), F.lower(F.hex(F.substring(c, 1, 32))).alias("head_hex"), F.md5(c).alias("md5"), F.sha1(c).alias("sha1"), F.sha2(c, 256).alias("sha256"),
    )
    return df.withColumn("file", record).drop("_family", "_label", "_names", "_entropy", "_latin", "_ext", "_script", "_by_ext", "_f", "_l")
