"""When each built-in rule fires, as SQL conditions over an observation; what it then says is with the rule.

Conditions cost little and are all looked at in one projection, so that evidence is only put together for rules that
fired. What several of them need is in :data:`SHARED`, projected once, under its name. A condition that is null is false.
"""

from __future__ import annotations

from .. import dims


def _in(values) -> str:
    return "(" + ", ".join(f"r'{v}'" for v in sorted(values)) + ")"


def _any(say: str, values) -> str:
    return "(" + " OR ".join(say.format(f"r'{v}'") for v in values) + ")"


RUNS = "(c.family IN ('pe', 'elf') OR coalesce(c.dangerous, false))"
#: name: SQL over the observation.
SHARED = {
    # The deepest layer with a child that runs; null without any.
    "_deepest": f"array_max(transform(filter(static.children, c -> coalesce({RUNS}, false)), c -> coalesce(c.depth, 1)))",
    "_program": "coalesce(file.family IN ('pe', 'elf'), false)",
}
CAPABLE = "try_element_at(static.pe.capabilities, '{}') IS NOT NULL"
MIXED = ("network", "persistence", "process_control", "credential_access", "keylogging")
WHEN = {
    "FILE_EXT_MISMATCH": "file.extension_mismatch <> ''",
    "FILE_NAME_DECEPTION": "size(file.filename_flags) > 0",
    "DANGEROUS_EXTENSION": "file.extension_is_dangerous",
    "OFFICE_MACRO_PRESENT": "size(static.vba.macros) > 0 AND static.vba.total_macro_lines > 0",
    "OFFICE_MACRO_AUTOEXEC": "size(static.vba.auto_exec) > 0",
    "OFFICE_MACRO_SHELL": f"exists(static.vba.suspicious_calls, c -> c.keyword IN {_in(dims.SHELL_CALLS)})",
    "OFFICE_MACRO_OBFUSCATED": f"exists(static.vba.suspicious_calls, c -> c.keyword IN {_in(dims.HIDING_CALLS)}) OR size(static.vba.deobfuscated) > 2",
    "OFFICE_REMOTE_TEMPLATE": "static.package.remote_template <> ''",
    "OFFICE_EXTERNAL_REL": "size(static.package.external_targets) > 0",
    "OFFICE_DDE": "static.dde.found",
    "OFFICE_XLM_MACRO": "static.xlm_macros_indicated",
    "OFFICE_EMBEDDED_OBJECT": "size(static.package.embedded_objects) > 0",
    "OFFICE_EMBEDDED_EXECUTABLE": "size(static.embedded_executables) > 0",
    "PDF_JAVASCRIPT": "static.javascript_present",
    "PDF_AUTO_ACTION": "static.structure.open_action <> '' OR size(static.structure.page_actions) > 0",
    "PDF_LAUNCH_ACTION": "size(static.structure.launch_actions) > 0 OR map_contains_key(static.keywords, '/Launch')",
    "PDF_EMBEDDED_FILE": "size(static.structure.embedded_files) > 0",
    "ARCHIVE_PASSWORD_PROTECTED": "static.password_protected",
    "ARCHIVE_DANGEROUS_CONTENT": "size(static.dangerous_entries) > 0 OR _deepest IS NOT NULL",
    "ARCHIVE_NESTED_EXECUTABLE": "_deepest >= 2",
    "ARCHIVE_DECOY_NAME": "size(static.decoy_names) > 0",
    "ARCHIVE_TRAVERSAL": "size(static.path_traversal) > 0",
    "ARCHIVE_BOMB": "static.zip_bomb_suspected",
    "ARCHIVE_CHILD_MISMATCH": "exists(static.children, c -> c.extension_mismatch <> '' OR size(c.filename_flags) > 0)",
    "PE_PACKED": "size(static.pe.packer_sections) > 0 OR exists(static.pe.sections, s -> s.entropy > 7.2D AND s.raw_size > 4096) OR static.pe.import_table_stripped",
    "PE_SELF_MODIFYING": "exists(static.pe.sections, s -> s.write_and_execute)",
    "PE_INJECTION_CAPABLE": CAPABLE.format("process_injection"),
    "PE_ANTI_ANALYSIS": CAPABLE.format("anti_analysis"),
    "PE_CAPABILITY_MIX": f"size(filter(map_keys(static.pe.capabilities), k -> k IN {_in(MIXED)})) >= 3",
    "PE_EMBEDDED_EXECUTABLE": "exists(static.pe.resources, r -> r.looks_executable) OR static.pe.overlay.looks_executable OR (static.pe.overlay.size > 65536 AND static.pe.overlay.entropy > 7.0D)",
    "PE_UNSIGNED": "static.pe.parsed AND NOT coalesce(static.pe.digitally_signed, false)",
    "PE_FAKE_TIMESTAMP": "static.pe.timestamp_implausible",
    "SCRIPT_OBFUSCATED": " OR ".join([*(f"size(static.deobfuscated.{k}) > 0" for k in ("fromcharcode", "hex_escapes", "reversed", "concatenated")), "static.single_line_obfuscation", "static.entropy > 5.6D"]),
    "SCRIPT_ENCODED_PAYLOAD": "exists(static.base64_blobs, b -> b.encoded_length > 200)",
    "SCRIPT_POWERSHELL_ABUSE": "size(static.powershell_indicators) >= 2",
    "SCRIPT_DROPPER_BEHAVIOUR": "size(dynamic.extracted_urls) > 0 OR size(dynamic.resources) > 0",
    "DYN_PROCESS_SPAWN": "size(dynamic.processes) > 0",
    "DYN_LOLBIN": "size(dynamic.lolbins_invoked) > 0",
    "DYN_NETWORK": "size(network.dns_queries) > 0 OR size(network.http_requests) > 0 OR size(network.connect_attempts) > 0",
    "DYN_EXFIL_ATTEMPT": "exists(network.http_requests, r -> r.method IN ('POST', 'PUT') AND r.body_len > 0)",
    "DYN_PERSISTENCE": "size(dynamic.persistence_paths) > 0",
    "DYN_DROPPED_EXECUTABLE": "size(dynamic.made_executable) > 0",
    "DYN_ANON_EXEC": "size(dynamic.anonymous_executables) > 0",
    "DYN_FILE_DESTRUCTION": "size(dynamic.files_deleted) >= 2",
    "IOC_SUSPICIOUS_TLD": f"exists(iocs.domains, d -> {_any('endswith(d, {})', dims.ABUSED_TLDS)})",
    "IOC_RAW_IP_URL": r"exists(iocs.urls, u -> u RLIKE r'(?U)^https?://\d{1,3}(\.\d{1,3}){3}')",
    "IOC_EXECUTABLE_URL": f"exists(transform(iocs.urls, u -> lower(substring_index(u, '?', 1))), u -> {_any('endswith(u, {})', dims.EXECUTABLE_URL_EXTS)})",
    "JAR_SUSPICIOUS_MANIFEST": "static.jar.main_class <> '' OR size(static.jar.suspicious_class_names) > 0 OR (static.jar IS NOT NULL AND NOT coalesce(static.jar.signed, false) AND static.jar.class_count > 0)",
    "OFFICE_XLM_HIDDEN_SHEET": "size(static.xlm_biff8_sheets) > 0",
    "IOC_SUSPICIOUS_DOMAIN_IN_BINARY": f"_program AND (exists(iocs.domains, d -> {_any('contains(lower(d), {})', dims.ABUSE_KEYWORDS)}) OR exists(static.file_iocs.domains, d -> {_any('contains(lower(d), {})', dims.ABUSE_KEYWORDS)}))",
}
