"""Observations made to order: for each rule what makes it fire, switched on by arithmetic on a row's number, so that SQL knows what to expect."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..rule_texts import RULES
from ..schemas import DYNAMIC, FILE, IOC, NETWORK, STATIC, ddl

#: What each rule looks for, by path; rules of one path each add their own items.
FIRES = {
    "FILE_EXT_MISMATCH": {"file.extension_mismatch": "content is a program"},
    "FILE_NAME_DECEPTION": {"file.filename_flags": ["double extension in filename"]},
    "DANGEROUS_EXTENSION": {"file.extension_is_dangerous": True},
    "OFFICE_MACRO_PRESENT": {"static.vba.macros": [{"name": "m", "lines": 3}], "static.vba.total_macro_lines": 3},
    "OFFICE_MACRO_AUTOEXEC": {"static.vba.auto_exec": ["autoopen"]},
    "OFFICE_MACRO_SHELL": {"static.vba.suspicious_calls": [{"keyword": sorted(dims.SHELL_CALLS)[0], "meaning": "m"}]},
    "OFFICE_MACRO_OBFUSCATED": {"static.vba.deobfuscated": ["one string", "two strings", "three"]},
    "OFFICE_REMOTE_TEMPLATE": {"static.package.remote_template": "http://h.example/t"},
    "OFFICE_EXTERNAL_REL": {"static.package.external_targets": [{"part": "p", "type": "t", "target": "u"}]},
    "OFFICE_DDE": {"static.dde.found": True},
    "OFFICE_XLM_MACRO": {"static.xlm_macros_indicated": True},
    "OFFICE_EMBEDDED_OBJECT": {"static.package.embedded_objects": ["o"]},
    "OFFICE_EMBEDDED_EXECUTABLE": {"static.embedded_executables": [{"offset": 7, "machine_bytes": "4c01"}]},
    "PDF_JAVASCRIPT": {"static.javascript_present": True},
    "PDF_AUTO_ACTION": {"static.structure.page_actions": [{"page": 1, "key": "/AA", "value": "v"}]},
    "PDF_LAUNCH_ACTION": {"static.structure.launch_actions": ["l"]},
    "PDF_EMBEDDED_FILE": {"static.structure.embedded_files": [{"name": "f", "size": 1}]},
    "ARCHIVE_PASSWORD_PROTECTED": {"static.password_protected": True},
    "ARCHIVE_DANGEROUS_CONTENT": {"static.dangerous_entries": [{"name": "e.exe", "extension": ".exe"}]},
    "ARCHIVE_NESTED_EXECUTABLE": {"static.children": [{"name": "n", "depth": 2, "family": "pe", "dangerous": False}]},
    "ARCHIVE_DECOY_NAME": {"static.decoy_names": [{"name": "d", "reason": "r"}]},
    "ARCHIVE_TRAVERSAL": {"static.path_traversal": ["../t"]},
    "ARCHIVE_BOMB": {"static.zip_bomb_suspected": True},
    "ARCHIVE_CHILD_MISMATCH": {"static.children": [{"name": "c", "depth": 1, "family": "text", "extension_mismatch": "m", "dangerous": False}]},
    "PE_PACKED": {"static.pe.packer_sections": ["UPX"]},
    "PE_SELF_MODIFYING": {"static.pe.sections": [{"name": "s", "raw_size": 1, "entropy": 1.0, "write_and_execute": True}]},
    "PE_INJECTION_CAPABLE": {"static.pe.capabilities": {"process_injection": ["i"]}},
    "PE_ANTI_ANALYSIS": {"static.pe.capabilities": {"anti_analysis": ["a"]}},
    "PE_CAPABILITY_MIX": {"static.pe.capabilities": {"network": ["n"], "persistence": ["p"], "keylogging": ["k"]}},
    "PE_EMBEDDED_EXECUTABLE": {"static.pe.resources": [{"type": "t", "size": 9, "looks_executable": True}]},
    "PE_UNSIGNED": {"static.pe.parsed": True},
    "PE_FAKE_TIMESTAMP": {"static.pe.timestamp_implausible": True},
    "SCRIPT_OBFUSCATED": {"static.single_line_obfuscation": True, "static.longest_line": 2000},
    "SCRIPT_ENCODED_PAYLOAD": {"static.base64_blobs": [{"encoded_length": 300, "encoding": "utf-8"}]},
    "SCRIPT_POWERSHELL_ABUSE": {"static.powershell_indicators": [{"flag": "a", "meaning": "b"}, {"flag": "c", "meaning": "d"}]},
    "SCRIPT_DROPPER_BEHAVIOUR": {"dynamic.extracted_urls": ["http://h.example/"]},
    "DYN_PROCESS_SPAWN": {"dynamic.processes": [{"path": "/p", "command": "p"}]},
    "DYN_LOLBIN": {"dynamic.lolbins_invoked": ["curl"]},
    "DYN_NETWORK": {"network.dns_queries": [{"qname": "a.example"}]},
    "DYN_EXFIL_ATTEMPT": {"network.http_requests": [{"method": "POST", "host": "h.example", "body_len": 5}]},
    "DYN_PERSISTENCE": {"dynamic.persistence_paths": [{"path": "/a", "meaning": "m"}]},
    "DYN_DROPPED_EXECUTABLE": {"dynamic.made_executable": [{"path": "/x", "mode": "0755", "makes_executable": True}]},
    "DYN_ANON_EXEC": {"dynamic.anonymous_executables": ["x"]},
    "DYN_FILE_DESTRUCTION": {"dynamic.files_deleted": ["/a", "/b"]},
    "IOC_SUSPICIOUS_TLD": {"iocs.domains": [f"q{sorted(dims.ABUSED_TLDS)[0]}"]},
    "IOC_RAW_IP_URL": {"iocs.urls": ["http://198.51.100.7/x"]},
    "IOC_EXECUTABLE_URL": {"iocs.urls": ["http://h.example/a.exe?q"]},
    "JAR_SUSPICIOUS_MANIFEST": {"static.jar.main_class": "a.B"},
    "OFFICE_XLM_HIDDEN_SHEET": {"static.xlm_biff8_sheets": [{"name": "s", "type": "xlm_macro", "visibility": "hidden", "hidden": True}]},
    "IOC_SUSPICIOUS_DOMAIN_IN_BINARY": {"file.family": "pe", "iocs.domains": [f"{dims.ABUSE_KEYWORDS[0]}.example"]},
    "IOC_HARDCODED_IP_IN_BINARY": {"file.family": "pe", "iocs.ips": ["45.1.2.3"]},
}
#: Rules that also fire by what another one looks for.
ALSO = {"ARCHIVE_DANGEROUS_CONTENT": ["ARCHIVE_NESTED_EXECUTABLE"], "DYN_NETWORK": ["DYN_EXFIL_ATTEMPT"]}
_ORDER = {r[0]: k for k, r in enumerate(RULES)}


def switch(rule: str, key: str) -> str:
    """SQL, of both engines, that says for which rows a rule's observations are made; the factor is no multiple of 11, so some are."""
    k = _ORDER[rule]
    return f"({key} * {k % 10 + 1} + {k}) % 11 < 3"


def fired(rule: str, key: str) -> str:
    return "(" + " OR ".join(switch(r, key) for r in [rule, *ALSO.get(rule, [])]) + ")"


def _value(kind: T.DataType, value) -> Column:
    return F.from_json(F.lit(json.dumps({"v": value})), T.StructType([T.StructField("v", kind)]))["v"]


def _made(kind: T.DataType, path: str, key: str) -> Column:
    if isinstance(kind, T.StructType) and not any(path in f for f in FIRES.values()):
        return F.struct(*[_made(f.dataType, f"{path}.{f.name}", key).alias(f.name) for f in kind])
    parts = [(F.expr(switch(rule, key)), found[path]) for rule, found in FIRES.items() if path in found]
    if not parts:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.concat(*[F.when(on, _value(kind, v)).otherwise(F.array().cast(kind)) for on, v in parts])
    if isinstance(kind, T.MapType):
        entry = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
        return F.map_from_entries(F.concat(*[F.when(on, _value(entry, [{"key": a, "value": b} for a, b in v.items()])).otherwise(F.array().cast(entry)) for on, v in parts]))
    return F.coalesce(*[F.when(on, _value(kind, v)) for on, v in parts])


def observations(key: str) -> list[Column]:
    """file, static, dynamic, network and iocs of a row with the number ``key``."""
    kinds = {"file": FILE, "static": STATIC, "dynamic": DYNAMIC, "network": NETWORK, "iocs": IOC}
    return [_made(ddl(f"x:{kind}")[0].dataType, name, key).alias(name) for name, kind in kinds.items()]
