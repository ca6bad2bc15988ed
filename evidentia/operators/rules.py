"""Detection rules as Column expressions over observations.

A rule is a function of the observation columns that gives ``array<string>``: null where it doesn't fire, its evidence
(possibly empty) where it does. Archived observations can be judged again by running this module alone. Rules never raise:
they only use access that gives null for what is missing. ``registry`` can be extended with :func:`rule`, or with a Python
callable through :func:`python_rule`, whose errors become ``RULE_ERROR`` rows of severity 0.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as X
from ..rule_texts import RULES
from ..schemas import SIGNATURE
from .predicates import SHARED, WHEN

STRINGS = "array<string>"


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: int
    description: str
    fires: Callable[[dict[str, Column]], Column]
    may_raise: bool = False


_texts = {r[0]: r for r in RULES}
registry: list[Rule] = []


def rule(id: str, name: str | None = None, severity: int | None = None, description: str | None = None):
    """Registers ``fn(obs) -> Column(array<string>)``; texts of built-in ids come from the table of rules."""

    def add(fn):
        known = _texts.get(id, (id, id, 0, ""))
        registry.append(Rule(id, name or known[1], known[2] if severity is None else severity, description or known[3], fn))
        return fn

    return add


def _list(c: Column, kind: str = STRINGS) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _some(items: Column, say=None, most: int | None = None) -> Column:
    """Evidence from a list that must not be empty."""
    kept = items if most is None else F.slice(items, 1, most)
    return F.when(F.size(items) > 0, F.transform(kept, say) if say else kept)


def _one(when: Column, *said: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(*said))


def _said(*parts) -> Column:
    """A string of literals and values; what is missing reads None, a boolean reads True or False."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def _number(c: Column) -> Column:
    """A double as shortest decimals: 7.0, 7.25."""
    return F.coalesce(F.regexp_replace(c.cast("string"), "E0$", ""), F.lit("None"))


def _truthy(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _kept(*items: tuple[Column, Column]) -> Column:
    """Evidence of those whose condition holds; null if none does."""
    every = F.concat(*[F.when(F.coalesce(c, F.lit(False)), e).otherwise(F.array().cast(STRINGS)) for c, e in items])
    return F.when(F.size(every) > 0, every)


# ---- identity and packaging
@rule("FILE_EXT_MISMATCH")
def _(o):
    return _one(_truthy(o["file"]["extension_mismatch"]), o["file"]["extension_mismatch"])


@rule("FILE_NAME_DECEPTION")
def _(o):
    return _some(o["file"]["filename_flags"])


@rule("DANGEROUS_EXTENSION")
def _(o):
    return _one(o["file"]["extension_is_dangerous"], _said("extension ", o["file"]["extension"]))


# ---- office
@rule("OFFICE_MACRO_PRESENT")
def _(o):
    vba = o["static"]["vba"]
    return _one((F.size(vba["macros"]) > 0) & (vba["total_macro_lines"] > 0), _said(F.size(vba["macros"]), " macro stream(s), ", vba["total_macro_lines"], " lines of VBA"))


@rule("OFFICE_MACRO_AUTOEXEC")
def _(o):
    return _some(o["static"]["vba"]["auto_exec"], lambda t: _said("trigger: ", t))


@rule("OFFICE_MACRO_SHELL")
def _(o):
    return _some(F.filter(o["static"]["vba"]["suspicious_calls"], lambda c: c["keyword"].isin(dims.SHELL_CALLS)), lambda c: _said(c["keyword"], " -- ", c["meaning"]))


@rule("OFFICE_MACRO_OBFUSCATED")
def _(o):
    vba = o["static"]["vba"]
    hiding = F.filter(_list(F.transform(vba["suspicious_calls"], lambda c: c["keyword"])), lambda k: k.isin(dims.HIDING_CALLS))
    rebuilt = _list(vba["deobfuscated"])
    told = F.concat(F.transform(hiding, lambda k: _said("obfuscation via ", k)), F.transform(F.slice(rebuilt, 1, 5), lambda s: _said("reconstructed string: ", F.substring(s, 1, 160))))
    return F.when((F.size(hiding) > 0) | (F.size(rebuilt) > 2), told)


@rule("OFFICE_REMOTE_TEMPLATE")
def _(o):
    target = o["static"]["package"]["remote_template"]
    return _one(_truthy(target), _said("attachedTemplate -> ", target))


@rule("OFFICE_EXTERNAL_REL")
def _(o):
    return _some(o["static"]["package"]["external_targets"], lambda t: _said(t["type"], " -> ", t["target"]), 8)


@rule("OFFICE_DDE")
def _(o):
    dde = o["static"]["dde"]
    return _one(dde["found"], F.substring(F.coalesce(dde["output"], F.lit("")), 1, 400))


@rule("OFFICE_XLM_MACRO")
def _(o):
    return _one(o["static"]["xlm_macros_indicated"], F.lit("Excel 4.0 macro markers found in the raw document"))


@rule("OFFICE_EMBEDDED_OBJECT")
def _(o):
    return _some(o["static"]["package"]["embedded_objects"], most=10)


@rule("OFFICE_EMBEDDED_EXECUTABLE")
def _(o):
    return _some(o["static"]["embedded_executables"], lambda p: _said("PE header at byte offset ", p["offset"]), 8)


# ---- PDF
@rule("PDF_JAVASCRIPT")
def _(o):
    blobs = _list(o["static"]["javascript"])
    return F.when(F.coalesce(o["static"]["javascript_present"], F.lit(False)), F.concat(F.array(_said(F.size(blobs), " JavaScript block(s)")), F.transform(F.slice(blobs, 1, 2), lambda b: F.substring(b, 1, 200))))


@rule("PDF_AUTO_ACTION")
def _(o):
    s = o["static"]["structure"]
    pages = F.transform(F.slice(s["page_actions"], 1, 5), lambda p: _said("page ", p["page"], " ", p["key"]))
    return _kept((_truthy(s["open_action"]), F.array(_said("/OpenAction: ", F.substring(s["open_action"], 1, 250)))), (F.size(s["page_actions"]) > 0, pages))


@rule("PDF_LAUNCH_ACTION")
def _(o):
    launches = _list(o["static"]["structure"]["launch_actions"])
    keyword = F.coalesce(F.map_contains_key(o["static"]["keywords"], "/Launch"), F.lit(False))
    return F.when(F.size(launches) > 0, F.slice(launches, 1, 5)).when(keyword, F.array(F.lit("/Launch keyword present in the document")))


@rule("PDF_EMBEDDED_FILE")
def _(o):
    return _some(o["static"]["structure"]["embedded_files"], lambda f: F.concat(_said(f["name"], " (", f["size"], " bytes, entropy "), _number(f["entropy"]), F.lit(")")), 8)


# ---- archives
def _runs(c: Column) -> Column:
    return F.coalesce(c["family"].isin("pe", "elf"), F.lit(False)) | F.coalesce(c["dangerous"], F.lit(False))


def _kind(c: Column) -> Column:
    return F.coalesce(c["label"], c["family"])


def _depth(c: Column) -> Column:
    return F.coalesce(c["depth"], F.lit(1))


@rule("ARCHIVE_PASSWORD_PROTECTED")
def _(o):
    return _one(o["static"]["password_protected"], F.lit("archive contents are encrypted and could not be inspected"))


@rule("ARCHIVE_DANGEROUS_CONTENT")
def _(o):
    entries, children = o["static"]["dangerous_entries"], F.filter(o["static"]["children"], _runs)
    level = lambda c: F.when(_depth(c) > 1, _said("depth ", _depth(c))).otherwise(F.lit("top level"))
    return _kept(
        (F.size(entries) > 0, F.transform(F.slice(entries, 1, 10), lambda e: _said(e["name"], " (", e["extension"], ")"))),
        (F.size(children) > 0, F.transform(F.slice(children, 1, 10), lambda c: _said(c["name"], " -> ", _kind(c), " (", level(c), ")"))),
    )


@rule("ARCHIVE_NESTED_EXECUTABLE")
def _(o):
    return _some(F.filter(o["static"]["children"], lambda c: (_depth(c) >= 2) & _runs(c)), lambda c: _said(c["name"], " at depth ", c["depth"], " (", _kind(c), ")"), 10)


@rule("ARCHIVE_DECOY_NAME")
def _(o):
    return _some(o["static"]["decoy_names"], lambda d: _said(d["name"], " -- ", d["reason"]), 10)


@rule("ARCHIVE_TRAVERSAL")
def _(o):
    return _some(o["static"]["path_traversal"], most=10)


@rule("ARCHIVE_BOMB")
def _(o):
    return _one(o["static"]["zip_bomb_suspected"], F.concat(F.lit("compression ratio "), _number(o["static"]["listing"]["compression_ratio"]), F.lit(":1")))


@rule("ARCHIVE_CHILD_MISMATCH")
def _(o):
    bad = F.filter(o["static"]["children"], lambda c: _truthy(c["extension_mismatch"]) | F.coalesce(F.size(c["filename_flags"]) > 0, F.lit(False)))
    listed = lambda flags: F.concat(F.lit("["), F.array_join(F.transform(flags, lambda f: F.concat(F.lit("'"), f, F.lit("'"))), ", "), F.lit("]"))
    return _some(bad, lambda c: _said(c["name"], ": ", F.when(_truthy(c["extension_mismatch"]), c["extension_mismatch"]).otherwise(listed(c["filename_flags"]))), 8)


# ---- programs
@rule("PE_PACKED")
def _(o):
    pe = o["static"]["pe"]
    high = F.filter(pe["sections"], lambda s: (s["entropy"] > 7.2) & (s["raw_size"] > 4096))
    return _kept(
        (F.size(pe["packer_sections"]) > 0, F.array(_said("known packer sections: ", F.array_join(pe["packer_sections"], ", ")))),
        (F.size(high) > 0, F.transform(F.slice(high, 1, 5), lambda s: F.concat(_said("section ", s["name"], " entropy "), _number(s["entropy"])))),
        (pe["import_table_stripped"], F.array(F.lit("import table has almost no entries; APIs are resolved at runtime"))),
    )


@rule("PE_SELF_MODIFYING")
def _(o):
    return _some(F.filter(o["static"]["pe"]["sections"], lambda s: s["write_and_execute"]), lambda s: _said("section ", s["name"], " is W+X"), 5)


def _capable(o, group: str) -> Column:
    return F.slice(F.try_element_at(o["static"]["pe"]["capabilities"], F.lit(group)), 1, 10)


@rule("PE_INJECTION_CAPABLE")
def _(o):
    return _capable(o, "process_injection")


@rule("PE_ANTI_ANALYSIS")
def _(o):
    return _capable(o, "anti_analysis")


@rule("PE_CAPABILITY_MIX")
def _(o):
    groups = F.array_sort(F.array_intersect(F.map_keys(o["static"]["pe"]["capabilities"]), X.array_of(["network", "persistence", "process_control", "credential_access", "keylogging"])))
    return _one(F.size(groups) >= 3, _said("capability groups present: ", F.array_join(groups, ", ")))


@rule("PE_EMBEDDED_EXECUTABLE")
def _(o):
    pe = o["static"]["pe"]
    inner, over = F.filter(pe["resources"], lambda r: r["looks_executable"]), pe["overlay"]
    holds = F.coalesce(over["looks_executable"], F.lit(False))
    return _kept(
        (F.size(inner) > 0, F.transform(inner, lambda r: _said("resource ", r["type"], " contains a PE (", r["size"], " bytes)"))),
        (holds, F.array(_said("overlay contains a PE (", over["size"], " bytes)"))),
        (~holds & (over["size"] > 65536) & (over["entropy"] > 7.0), F.array(F.concat(_said("high-entropy overlay of ", over["size"], " bytes (entropy "), _number(over["entropy"]), F.lit(")")))),
    )


@rule("PE_UNSIGNED")
def _(o):
    pe = o["static"]["pe"]
    return _one(pe["parsed"] & ~F.coalesce(pe["digitally_signed"], F.lit(False)), F.lit("no Authenticode signature present"))


@rule("PE_FAKE_TIMESTAMP")
def _(o):
    return _one(o["static"]["pe"]["timestamp_implausible"], _said("compile time reported as ", o["static"]["pe"]["compile_time"]))


# ---- scripts
@rule("SCRIPT_OBFUSCATED")
def _(o):
    s = o["static"]
    parts = [_list(s["deobfuscated"][k]) for k in ("fromcharcode", "hex_escapes", "reversed", "concatenated")]
    count = sum((F.size(p) for p in parts[1:]), F.size(parts[0]))
    told = F.concat(F.array(_said(count, " string(s) reconstructed from runtime obfuscation")), *[F.transform(F.slice(p, 1, 2), lambda v: _said("reconstructed: ", F.substring(v, 1, 160))) for p in parts])
    every = _kept((count > 0, told), (s["single_line_obfuscation"], F.array(_said("one line of ", s["longest_line"], " characters"))), (s["entropy"] > 5.6, F.array(F.concat(F.lit("source entropy "), _number(s["entropy"])))))
    return F.slice(every, 1, 8)


@rule("SCRIPT_ENCODED_PAYLOAD")
def _(o):
    big = F.filter(o["static"]["base64_blobs"], lambda b: b["encoded_length"] > 200)
    return _some(big, lambda b: F.concat(_said(b["encoded_length"], " chars, ", b["encoding"], ", entropy "), _number(b["entropy"]), F.when(b["looks_like_pe"], F.lit(", decodes to a PE file")).otherwise(F.lit(""))), 5)


@rule("SCRIPT_POWERSHELL_ABUSE")
def _(o):
    hits = o["static"]["powershell_indicators"]
    return F.when(F.size(hits) >= 2, F.transform(F.slice(hits, 1, 10), lambda i: _said(i["flag"], " -- ", i["meaning"])))


@rule("SCRIPT_DROPPER_BEHAVIOUR")
def _(o):
    got = o["dynamic"]["resources"]
    return _kept(
        (F.size(o["dynamic"]["extracted_urls"]) > 0, F.transform(F.slice(o["dynamic"]["extracted_urls"], 1, 8), lambda u: _said("resolved URL: ", u))),
        (F.size(got) > 0, F.transform(F.slice(got, 1, 5), lambda r: F.concat(_said("dropped ", r["name"], " (", r["size"], " bytes)"), F.when(r["looks_like_pe"], F.lit(", a PE file")).otherwise(F.lit(""))))),
    )


# ---- behaviour
@rule("DYN_PROCESS_SPAWN")
def _(o):
    return _some(o["dynamic"]["processes"], lambda p: F.substring(p["command"], 1, 300), 10)


@rule("DYN_LOLBIN")
def _(o):
    return _some(o["dynamic"]["lolbins_invoked"], most=10)


@rule("DYN_NETWORK")
def _(o):
    n = o["network"]
    dns, http, tcp = n["dns_queries"], n["http_requests"], n["connect_attempts"]
    return _kept(
        (F.size(dns) > 0, F.transform(F.slice(dns, 1, 8), lambda q: _said("DNS lookup for ", q["qname"]))),
        (F.size(http) > 0, F.transform(F.slice(http, 1, 8), lambda r: _said(r["method"], " ", r["scheme"], "://", r["host"], r["path"]))),
        (F.size(tcp) > 0, F.transform(F.slice(tcp, 1, 8), lambda c: _said("TCP connect to ", c["ip"], ":", c["port"]))),
    )


@rule("DYN_EXFIL_ATTEMPT")
def _(o):
    sent = F.filter(o["network"]["http_requests"], lambda r: r["method"].isin("POST", "PUT") & (r["body_len"] > 0))
    return _some(sent, lambda r: _said(r["method"], " to ", r["host"], r["path"], " with ", r["body_len"], " bytes of body"), 6)


@rule("DYN_PERSISTENCE")
def _(o):
    return _some(o["dynamic"]["persistence_paths"], lambda p: _said(p["path"], " -- ", p["meaning"]), 10)


@rule("DYN_DROPPED_EXECUTABLE")
def _(o):
    return _some(o["dynamic"]["made_executable"], lambda e: _said("chmod ", e["mode"], " ", e["path"]), 10)


@rule("DYN_ANON_EXEC")
def _(o):
    return _some(o["dynamic"]["anonymous_executables"], most=10)


@rule("DYN_FILE_DESTRUCTION")
def _(o):
    return F.when(F.size(o["dynamic"]["files_deleted"]) >= 2, F.slice(o["dynamic"]["files_deleted"], 1, 10))


# ---- indicators
@rule("IOC_SUSPICIOUS_TLD")
def _(o):
    return _some(F.filter(o["iocs"]["domains"], lambda d: F.exists(X.array_of(dims.ABUSED_TLDS), lambda t: F.endswith(d, t))), most=10)


@rule("IOC_RAW_IP_URL")
def _(o):
    return _some(F.filter(o["iocs"]["urls"], lambda u: u.rlike(r"(?U)^https?://\d{1,3}(\.\d{1,3}){3}")), most=10)


@rule("IOC_EXECUTABLE_URL")
def _(o):
    return _some(F.filter(o["iocs"]["urls"], lambda u: F.exists(X.array_of(dims.EXECUTABLE_URL_EXTS), lambda e: F.endswith(F.lower(F.substring_index(u, "?", 1)), e))), most=10)


@rule("JAR_SUSPICIOUS_MANIFEST")
def _(o):
    jar = o["static"]["jar"]
    odd, count = _list(jar["suspicious_class_names"], "array<struct<class:string,matched_keywords:array<string>>>"), F.coalesce(jar["class_count"], F.lit(0))
    starts, unsigned = _truthy(jar["main_class"]), ~F.coalesce(jar["signed"], F.lit(False))
    told = _kept(
        (starts, F.array(_said("Main-Class: ", jar["main_class"], " (directly executable)"))),
        (F.size(odd) > 0, F.transform(F.slice(odd, 1, 5), lambda s: _said("suspicious class: ", s["class"], " (keywords: ", F.array_join(s["matched_keywords"], ", "), ")"))),
        (unsigned, F.array(F.lit("JAR is not digitally signed"))),
        (count > 0, F.array(_said(count, " class file(s)"))),
    )
    return F.when(jar.isNotNull() & (starts | (F.size(odd) > 0) | (unsigned & (count > 0))), told)


@rule("OFFICE_XLM_HIDDEN_SHEET")
def _(o):
    sheets = o["static"]["xlm_biff8_sheets"]
    hidden = F.filter(sheets, lambda s: s["hidden"])
    return F.when(F.size(hidden) > 0, F.transform(F.slice(hidden, 1, 10), lambda s: _said("sheet '", s["name"], "' is ", s["visibility"], " (", s["type"], ")"))).when(F.size(sheets) > 0, F.transform(F.slice(sheets, 1, 10), lambda s: _said("sheet '", s["name"], "' is a ", s["type"], " sheet")))


def _in_program(o, kind: str) -> Column:
    """Indicators of a program, distinct and sorted, as sets have no order of their own; none for other families."""
    every = F.array_sort(F.array_distinct(F.concat(_list(o["iocs"][kind]), _list(o["static"]["file_iocs"][kind]))))
    return F.when(o["file"]["family"].isin("pe", "elf"), every)


@rule("IOC_SUSPICIOUS_DOMAIN_IN_BINARY")
def _(o):
    word = lambda d: F.get(F.filter(X.array_of(dims.ABUSE_KEYWORDS), lambda k: F.contains(F.lower(d), k)), F.lit(0))
    hits = F.filter(_in_program(o, "domains"), lambda d: word(d).isNotNull())
    return _some(hits, lambda d: _said(d, " (matches '", word(d), "')"), 10)


@rule("IOC_HARDCODED_IP_IN_BINARY")
def _(o):
    return _some(F.filter(_in_program(o, "ips"), X.is_remote_ip), most=10)


def python_rule(id: str, name: str, severity: int, description: str, fn: Callable[[dict], list | dict | None]) -> Rule:
    """A rule from a Python callable of the observations as nested dicts; batches reach it by Arrow as JSON."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        def one(said):
            try:
                got = fn(json.loads(said))
            except Exception as e:  # a broken rule is a finding of its own
                return ["\0RULE_ERROR", f"{type(e).__name__}: {e}"]
            got = got.get("evidence") or [] if isinstance(got, dict) and got else got
            return None if got is None or got == {} else [str(x) for x in got]

        return rows.map(one)

    return Rule(id, name, severity, description, lambda o: run(F.to_json(F.struct(*[v.alias(k) for k, v in o.items()]))), may_raise=True)


def _ranked(rules: list[Rule]) -> list[Rule]:
    """Strongest first, ties in the order of registration; so nothing is sorted at run time."""
    return [r for _, r in sorted(enumerate(rules), key=lambda x: (-x[1].severity, x[0]))]


_COLUMNS = ("file", "static", "dynamic", "network", "iocs")
_made: dict[tuple, Column] = {}


def _evidence(r: Rule) -> Column:
    """What a rule says; expressions are made once for each JVM, as making them costs more than judging many rows."""
    key = (id(SparkContext._gateway), r)
    if key not in _made:
        _made[key] = r.fires({k: F.col(k) for k in _COLUMNS})
    return _made[key]


def conditions(obs: DataFrame, rules: list[Rule], into: str) -> DataFrame:
    """``obs`` plus an array of booleans: which of ``rules`` fire. No evidence is made, but for rules that state no condition."""
    known = [r for r in rules if (r.id, r.fires) in _stated]
    shared = {k: F.expr(v) for k, v in SHARED.items() if any(k in WHEN[r.id] for r in known)}
    made = {f"_says{i}": _evidence(r).isNotNull() for i, r in enumerate(rules) if r not in known}
    parts = [f"coalesce({WHEN[r.id]}, false)" if r in known else f"_says{i}" for i, r in enumerate(rules)]
    on = F.expr(f"array({', '.join(parts)})") if parts else F.array().cast("array<boolean>")
    return obs.withColumns(shared | made).withColumn(into, on).drop(*shared, *made)


def fired(obs: DataFrame, rules: list[Rule] | None = None, into: str = "fired") -> DataFrame:
    """``obs`` plus (id, severity) of the fired rules, strongest first, from their conditions alone.

    Enough for scores, levels and the strongest few; texts are joined by id from :func:`catalogue`, evidence is :func:`evaluate`'s.
    """
    ranked = _ranked(registry if rules is None else rules)
    if any(r.may_raise for r in ranked):
        short = F.transform("_full", lambda s: F.struct(s["id"].alias("id"), s["severity"].alias("severity")))
        return evaluate(obs, rules, "_full").withColumn(into, short).drop("_full")
    # No lambda around the conditions: one that was moved into it would be evaluated for each element.
    rows = ", ".join(f"if(_on[{k}], named_struct('id', '{r.id}', 'severity', {r.severity}), NULL)" for k, r in enumerate(ranked))
    found = F.expr(f"array_compact(array({rows}))") if ranked else F.array().cast("array<struct<id:string,severity:int>>")
    return conditions(obs, ranked, "_on").withColumn(into, found).drop("_on")


def evaluate(obs: DataFrame, rules: list[Rule] | None = None, into: str = "signatures") -> DataFrame:
    """``obs`` plus the fired rules, strongest first, ties in the order of registration; at most 12 pieces of evidence each."""
    ranked = _ranked(registry if rules is None else rules)

    def said(k: int, r: Rule) -> Column:
        e = _evidence(r)
        clean = F.slice(F.filter(e, lambda x: x.isNotNull() & (x != "")), 1, 12)
        row = F.struct(F.lit(r.id).alias("id"), F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity"), F.lit(r.description).alias("description"), clean.alias("evidence"))
        if r.may_raise:
            error = F.struct(F.lit("RULE_ERROR").alias("id"), F.lit(f"rule {r.id} failed").alias("name"), F.lit(0).alias("severity"), F.lit("This detection rule raised an exception and was skipped.").alias("description"), F.slice(clean, 2, 1).alias("evidence"))
            row = F.when(F.coalesce(F.get(e, F.lit(0)) == "\0RULE_ERROR", F.lit(False)), error).otherwise(row)
        return F.when(F.expr(f"_on[{k}]"), row)

    every = F.array_compact(F.array(*[said(k, r) for k, r in enumerate(ranked)])).cast(f"array<{SIGNATURE}>")
    if any(r.may_raise for r in ranked):  # broken rules, of severity 0, come last
        every = F.array_sort(every, lambda x, y: (x["id"] == "RULE_ERROR").cast("int") - (y["id"] == "RULE_ERROR").cast("int"))
    return conditions(obs, ranked, "_on").withColumn(into, every).drop("_on")


def catalogue(spark, rules: list[Rule] | None = None) -> DataFrame:
    """Rules by falling severity."""
    rows = [(i, r.id, r.name, r.severity, r.description) for i, r in enumerate(registry if rules is None else rules)]
    return spark.createDataFrame(rows, "rule_ord int, id string, name string, severity int, description string").orderBy(F.desc("severity"), "rule_ord")


assert [r.id for r in registry] == [r[0] for r in RULES]
#: Built-in rules whose conditions are stated; one that was put in their place has its own.
_stated = {(r.id, r.fires) for r in registry if r.id in WHEN}
