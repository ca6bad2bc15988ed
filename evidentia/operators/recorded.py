"""What recorded outputs of tools and emulators add to observations; the tools themselves aren't run here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..functions import text as X
from ..schemas import DYNAMIC, ddl
from .trace import dynamic_reason

# --- fixed values: script families by what runs them
EMULATED, NATIVE = ("js", "vbs", "wsf", "hta"), ("sh", "py")
RESOURCES = "array<struct<name:string,size:bigint,entropy:double,looks_like_pe:boolean,sha256:string>>"
OUTPUTS = {"dde": "string", "oleobj": "string", "olemeta": "string", "oledir": "string", "macro_emulator": "string", "script_iocs": "string", "script_urls": "string", "script_active_urls": "string", "resources": RESOURCES, "stdout": "string", "detonate": "boolean"}


def _iocs(text: Column) -> Column:
    return X.iocs(X.latin1(text.cast("binary")))


def _dynamic(known: dict[str, Column]) -> Column:
    return F.struct(*[(known[f.name] if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in ddl(f"d:{DYNAMIC}")[0].dataType])


def apply(obs: DataFrame, outputs: DataFrame | None) -> DataFrame:
    """``obs`` (job_id, file, static, dynamic) with ``outputs``, a row for each job of texts as tools printed them.

    Columns, any of which may lack: dde (JSON), oleobj, olemeta, oledir, macro_emulator, script_iocs, script_urls and
    script_active_urls (JSON; the last stands for script_urls where both are there), resources, stdout, and detonate (true unless false).
    Scripts that nothing ran say why; without ``outputs`` that is all that is added.
    """
    have = [] if outputs is None else [c for c in OUTPUTS if c in outputs.columns]
    df = obs if outputs is None else obs.join(outputs.select("job_id", *[F.col(c).alias(f"_{c}") for c in have]), "job_id", "left")
    for c, kind in OUTPUTS.items():
        if c not in have:
            df = df.withColumn(f"_{c}", F.lit(None).cast(kind))
    s, d, family = F.col("static"), F.col("dynamic"), F.col("file.family")
    office = s["engine"] == "office"
    told = s.withField("dde", F.coalesce(F.when(F.col("_dde").isNotNull(), sources.dde(F.col("_dde"))), s["dde"]))
    told = told.withField("ole_objects", F.when(F.col("_oleobj").isNotNull(), F.struct(X.truncate(F.col("_oleobj"), 2000).alias("output"), _iocs(F.col("_oleobj"))["urls"].alias("found_urls"))).otherwise(s["ole_objects"]))
    told = told.withField("metadata", X.truncate(F.col("_olemeta"), 2000)).withField("streams", X.truncate(F.col("_oledir"), 3000))
    df = df.withColumn("static", F.when(office, told).otherwise(s))

    xlm, macros = s["xlm_macros_indicated"], (F.size(s["vba"]["macros"]) > 0) | (F.size(s["vba"]["auto_exec"]) > 0)
    ran = F.col("_macro_emulator").isNotNull()
    emulated = _dynamic({"executed": ran, "engine": F.when(xlm & ran, "xlmdeobfuscator").when(ran, "vipermonkey").otherwise("emulation"), "reason": F.when(~ran & ~F.coalesce(xlm | macros, F.lit(False)), "No macros detected to emulate"), "output": X.truncate(F.col("_macro_emulator"), 8000), "iocs": _iocs(F.col("_macro_emulator"))})
    urls = sources.emulator_urls(F.col("_script_iocs"), F.coalesce("_script_active_urls", "_script_urls"))
    dropped = F.coalesce("_resources", F.array().cast(RESOURCES))
    seen = F.col("_script_iocs").isNotNull() | F.col("_script_urls").isNotNull() | F.col("_script_active_urls").isNotNull() | F.col("_resources").isNotNull()
    boxed = _dynamic({"executed": F.lit(True), "engine": F.lit("box-js"), "extracted_urls": urls, "resources": dropped})
    engine, reason = dynamic_reason(family, F.coalesce("_detonate", F.lit(True)))
    idle = _dynamic({"executed": F.lit(False), "engine": engine, "reason": reason})
    script = s["engine"] == "script"
    waits = family.isin(*EMULATED, *NATIVE) & F.coalesce("_detonate", F.lit(True))  # what could run but left no record
    made = F.when(d.isNotNull(), d).when(office & (ran | (F.lit(outputs is not None) & F.col("_dde").isNotNull())), emulated).when(script & family.isin(*EMULATED) & seen, boxed).when(script & ~waits, idle)
    made = F.when(F.col("_stdout").isNotNull() & made.isNotNull(), made.withField("stdout_iocs", _iocs(F.col("_stdout")))).otherwise(made)
    return df.withColumn("dynamic", made).drop(*[f"_{c}" for c in OUTPUTS])
