"""SQL twins of the registered queries, in the dialect of the driver's oracle. RE2 there has no lookarounds, and its ``\\b`` is ASCII."""

from __future__ import annotations

from .. import dims
from ..rule_texts import RULES
from ..operators.scoring import confidence_of
from . import samples


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


DOCS = "(SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)"
PAGE_TEXT = "(SELECT page_id, concat_ws(' ', url, html) AS text, url, html FROM pages)"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"\b({OCTET}(?:\.{OCTET}){{3}})\b"
EMAIL = r"(?i)\b([a-z0-9._%+-]{1,64}@[a-z0-9.-]{1,255}\.[a-z]{2,24})\b"
DOMAIN = rf"(?i)\b((?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+(?:{dims.DOMAIN_TLDS}))\b"
URL = r"(?i)\b((?:https?|ftp|file)://[!-~]{4}[!#-&(*+\-./0-:=?-\[^-|~]*)"
BENIGN = f"(list_contains({_list(dims.BENIGN_DOMAINS)}, v) OR len(list_filter({_list(dims.BENIGN_DOMAINS)}, lambda b: ends_with(v, '.' || b))) > 0)"


def _found(key: str, table: str, pattern: str, name: str, value: str = "v", keep: str = "true", limit: int = 200) -> str:
    """Distinct matches of each row, in order of first occurrence, at most ``limit``."""
    return f"""
WITH m AS (SELECT {key}, unnest(regexp_extract_all(text, {_q(pattern)}, 1)) AS v, generate_subscripts(regexp_extract_all(text, {_q(pattern)}, 1), 1) AS i FROM {table}),
d AS (SELECT {key}, {value} AS v, min(i) AS i FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY i) AS k FROM d WHERE {keep})
SELECT {key}, v AS {name} FROM r WHERE k <= {limit}"""


def _cases(rows, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {_q(v)}" for c, v in rows) + f" ELSE {otherwise} END"


_IPS = _found("doc_id", DOCS, IPV4, "ip", keep=f"v NOT IN ({', '.join(map(_q, dims.BENIGN_IPS))})")
_TEXT_RATIO = r"length(regexp_replace(head, '[^\x20-\x7E\t\n\r]', '', 'g')) / length(head)"

_BYTE_RATIO = _TEXT_RATIO.replace("/ length(head)", "/ strlen(head)")


def _magic(what: int, column: str = "html") -> str:
    rows = []
    for sig, at, fam, lab in dims.MAGIC:
        rows.append((f"upper(substr(hex(encode(coalesce({column}, ''))), {2 * at + 1}, {len(sig)})) = '{sig}'", (fam, lab)[what]))
    return _cases(rows, "'unknown'")


EXT = r"lower(regexp_extract(regexp_extract(u, '([^/]*)$', 1), '^\.*[^.].*?(\.[^.]*)$', 1))"
SEV = "(l_partkey % 17) * 5 + 5"
SCORES = f"""
s AS (SELECT l_orderkey, {SEV} AS sev, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SEV} DESC) - 1 AS k FROM lineitem),
p AS (SELECT l_orderkey, 100 - 100 * product(1 - sev / 100.0 * pow(0.6::DOUBLE, k)) AS x, max(sev) AS top, least(count(*) FILTER (sev >= 40), 4) AS strong FROM s GROUP BY 1),
v AS (SELECT l_orderkey, top, strong, CAST(round_even(round(x, 9), 0) AS INTEGER) AS score FROM p)"""
LEVEL = "CASE WHEN score >= 70 THEN 'malicious' WHEN score >= 35 THEN 'suspicious' ELSE 'benign' END"
FLOW_JOBS = "(SELECT user_id AS job_id, min(ts) AS a, min(ts) + INTERVAL 6 HOURS AS z FROM events GROUP BY 1)"


#: Jobs of a user and a day: queued, running, ended within six hours, or timed out by the time that is known, an hour before the last event.
JOB_LIFE = """WITH w AS (SELECT max(ts) - INTERVAL 1 HOUR AS now FROM events WHERE event_type <> 'click'),
e AS (SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS job_id, min(ts) FILTER (event_type = 'signup') AS q, min(ts) FILTER (event_type = 'view') AS s,
  min(ts) FILTER (event_type IN ('purchase', 'error')) AS f, arg_min(event_type, ts) FILTER (event_type IN ('purchase', 'error')) AS how
  FROM events WHERE event_type <> 'click' GROUP BY 1),
d AS (SELECT *, s + INTERVAL 6 HOURS AS z, f IS NOT NULL AND coalesce(f <= s + INTERVAL 6 HOURS, true) AS done FROM e)
SELECT job_id, CASE WHEN done THEN CASE how WHEN 'error' THEN 'failed' ELSE 'completed' END WHEN z <= now OR f > z THEN 'timeout' WHEN s IS NOT NULL THEN 'running' ELSE 'queued' END AS status,
  strftime(q, '%Y-%m-%d %H:%M:%S.%f') AS queued_at, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
  strftime(CASE WHEN done THEN f WHEN z <= now OR f > z THEN z END, '%Y-%m-%d %H:%M:%S.%f') AS ended_at FROM d, w"""


CAP = 120
#: Flows of each user's job, numbered by kind; views and anything else are sessions.
COLLECTED = f"""r AS (SELECT job_id, event_id, event_type, row_number() OVER (PARTITION BY job_id, CASE WHEN event_type IN ('click', 'purchase') THEN event_type END ORDER BY event_id) AS k
FROM events JOIN {FLOW_JOBS} ON user_id = job_id AND ts BETWEEN a AND z)"""
#: Rules that fire for an order's number, strongest first (s), and what they add up to (v).
JUDGED = f"""x AS (SELECT o_orderkey, unnest([{", ".join(f"CASE WHEN {samples.fired(r[0], 'o_orderkey')} THEN {k} END" for k, r in enumerate(RULES))}]) AS ord FROM orders),
s AS (SELECT o_orderkey, id, sev, row_number() OVER (PARTITION BY o_orderkey ORDER BY sev DESC, ord) AS k FROM x JOIN (VALUES {", ".join(f"({k}, '{r[0]}', {r[2]})" for k, r in enumerate(RULES))}) AS t(ord, id, sev) USING (ord)),
p AS (SELECT o_orderkey, string_agg(id, ',' ORDER BY k) AS ids, 100 - 100 * product(1 - sev / 100.0 * pow(0.6::DOUBLE, k - 1)) AS x, max(sev) AS top, least(count(*) FILTER (sev >= 40), 4) AS strong FROM s GROUP BY 1),
v AS (SELECT o_orderkey, coalesce(ids, '') AS ids, CAST(coalesce(round_even(round(x, 9), 0), 0) AS INTEGER) AS score, top, strong FROM orders LEFT JOIN p USING (o_orderkey))"""


def oracles() -> dict[str, str]:
    strings = rf"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '([\x20-\x7e]{{6,}})', 1)) AS v, generate_subscripts(regexp_extract_all(text, '([\x20-\x7e]{{6,}})', 1), 1) AS i FROM {DOCS}),
d AS (SELECT doc_id, v, min(i) AS i FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM d) SELECT doc_id, v AS run FROM r WHERE k <= 400"""
    host = "regexp_extract(coalesce(url, ''), '^https?://([^/?#:]+)', 1)"
    conf = ", ".join(f"({t}, {k}, {confidence_of(t, k)!r}::DOUBLE)" for t in range(0, 101, 5) for k in range(5))
    scripts = [(f"regexp_matches(low, {_q(p)})", f) for f, p in dims.SCRIPT_CONTENT]
    return {
        "ioc_ips": _IPS,
        "ioc_emails": _found("doc_id", DOCS, EMAIL, "email", value="lower(v)"),
        "ioc_domains": _found("page_id", PAGE_TEXT, DOMAIN, "domain", value="lower(v)", keep=f"NOT {BENIGN}"),
        "ioc_urls": _found("page_id", PAGE_TEXT, URL, "url", value="rtrim(v, '.,;')"),
        "ioc_rollup_by_lang": f"SELECT lang, count(*) AS n, count(DISTINCT ip) AS ips, count(DISTINCT doc_id) AS docs FROM ({_IPS}) JOIN documents USING (doc_id) GROUP BY lang",
        "ioc_benign_antijoin": f"WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS v FROM pages) SELECT page_id, v AS host FROM h WHERE v <> '' AND NOT {BENIGN} AND NOT ends_with(v, '.example.org')",
        "text_entropy": f"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM {DOCS}), n AS (SELECT doc_id, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY 1, 2),
e AS (SELECT doc_id, -sum(p * log2(p)) AS e FROM (SELECT doc_id, k / sum(k) OVER (PARTITION BY doc_id) AS p FROM n) GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text = '' THEN 0.0 ELSE round(e, 3) END AS entropy FROM {DOCS} d LEFT JOIN e ON d.doc_id = e.doc_id""",
        "longest_line": rf"SELECT doc_id, list_max(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: length(x))) AS longest, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM {DOCS}",
        "keyword_hits": f"SELECT k AS keyword, count(*) AS pages FROM pages, unnest({_list(dims.ABUSE_KEYWORDS)}) AS t(k) WHERE contains(lower(coalesce(html, '')), k) GROUP BY 1",
        "keyword_count": "SELECT page_id, " + ", ".join(f"CAST((length(coalesce(html, '')) - length(replace(coalesce(html, ''), {_q(w)}, ''))) // {len(w)} AS BIGINT) AS n_{w.strip('/')}" for w in ("the", "/a", "script")) + " FROM pages",
        "is_text": rf"SELECT doc_id, coalesce(length(head) > 0 AND NOT contains(head[:1024], chr(0)) AND {_TEXT_RATIO} > 0.9, false) AS is_text, CASE WHEN length(head) > 0 THEN round({_TEXT_RATIO}, 6) END AS ratio FROM (SELECT doc_id, text[:65536] AS head FROM {DOCS})",
        "script_family": f"SELECT page_id, {_cases(scripts, 'NULL')} AS family FROM (SELECT page_id, lower(coalesce(html, '')[:4096]) AS low FROM pages)",
        "magic_family": f"SELECT page_id, {_magic(0)} AS family, {_magic(1)} AS label FROM pages",
        "ext_and_flags": rf"SELECT page_id, {EXT} AS ext, list_contains({_list(dims.DANGEROUS_EXTS)}, {EXT}) AS dangerous, CAST(contains(u, chr(8238))::INT + regexp_matches(u, '(?i)\.(jpg|jpeg|png|gif|pdf|doc|docx|xls|xlsx|txt|mp4)\s*\.\w+$')::INT + (length(regexp_replace(u, '\S', '', 'g')) > 12 OR contains(u, '        '))::INT AS BIGINT) AS flags FROM (SELECT page_id, coalesce(regexp_replace(url, '[?#].*$', ''), '') AS u FROM pages)",
        "url_rules": rf"SELECT page_id, len(list_filter({_list(dims.ABUSED_TLDS)}, lambda x: ends_with({host}, x))) > 0 AS bad_tld, regexp_matches(coalesce(url, ''), '^https?://\d{{1,3}}(\.\d{{1,3}}){{3}}') AS raw_ip, len(list_filter({_list(dims.EXECUTABLE_URL_EXTS)}, lambda x: ends_with(lower(split_part(coalesce(url, ''), '?', 1)), x))) > 0 AS runs FROM pages",
        "hashes": f"SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM {DOCS}",
        "defang_text": rf"SELECT doc_id, md5(regexp_replace(text, '\b(\d{{1,3}})\.(\d{{1,3}})\.(\d{{1,3}})\.(\d{{1,3}})\b', '\1[.]\2[.]\3[.]\4', 'g')) AS defanged FROM {DOCS}",
        "defang_hosts": rf"SELECT page_id, CASE WHEN regexp_full_match({host}, '\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}') THEN replace({host}, '.', '[.]') ELSE regexp_replace({host}, '\.([^.]*)$', '[.]\1') END AS host, regexp_replace(coalesce(url, ''), '^http(s?)://', 'hxxp\1://')[:8] || '' || CASE WHEN url IS NULL THEN '' ELSE replace(regexp_extract(regexp_replace(url, '^http(s?)://', 'hxxp\1://')[9:], '^([^/:]*)', 1), '.', '[.]') || regexp_extract(regexp_replace(url, '^http(s?)://', 'hxxp\1://')[9:], '^[^/:]*(.*)$', 1) END AS url FROM pages",
        "strings_runs": strings,
        "strings_lateral": strings,
        # Documents as attachments named *.pdf: a signature, else a script by its content, else text; text families never mismatch.
        "triage_documents": rf"""WITH d AS (SELECT doc_id, text, text[:65536] AS head, lower(text[:4096]) AS low, {_magic(0, "text")} AS m, {_magic(1, "text")} AS ml FROM {DOCS}),
f AS (SELECT *, m = 'unknown' AND length(head) > 0 AND NOT contains(head[:1024], chr(0)) AND {_BYTE_RATIO} > 0.9 AS textual, {_cases(scripts, 'NULL')} AS script FROM d)
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, CASE WHEN textual THEN coalesce(script, 'text') ELSE m END AS family,
  CASE WHEN textual THEN coalesce(script || ' script (by content)', 'plain text') ELSE ml END AS label, '.pdf' AS extension, CAST(NULL AS VARCHAR) AS mismatch,
  sha256(text) AS sha256, lower(hex(encode(text))[:64]) AS head_hex FROM f""",
        "flow_window_join": f"SELECT job_id, event_id, event_type FROM events JOIN {FLOW_JOBS} ON user_id = job_id AND ts BETWEEN a AND z",
        "network_stream": f"SELECT job_id, event_id, event_type FROM events JOIN {FLOW_JOBS} ON user_id = job_id AND ts BETWEEN a AND z",
        "job_life": JOB_LIFE,
        "rule_scores": f"WITH {SCORES} SELECT l_orderkey, score FROM v",
        "verdict_levels": f"WITH {SCORES} SELECT {LEVEL} AS level, count(*) AS n, min(score) AS low, max(score) AS high FROM v GROUP BY 1",
        "confidence": f"WITH {SCORES}, c(top, strong, confidence) AS (VALUES {conf}) SELECT l_orderkey, confidence FROM v JOIN c USING (top, strong)",
        "rule_list": f"WITH {JUDGED}, n AS (SELECT id, count(*) AS orders FROM s GROUP BY 1) SELECT id, name, severity, description, coalesce(orders, 0) AS orders FROM (VALUES " + ", ".join(f"({_q(i)}, {_q(n)}, {s}, {_q(d)})" for i, n, s, d in RULES) + ") AS t(id, name, severity, description) LEFT JOIN n USING (id)",
        "job_listing": "SELECT o_orderkey AS job_id, o_orderstatus AS status, o_orderkey AS seq FROM orders ORDER BY o_orderkey DESC LIMIT 50",
        "job_retention": "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 24 HOURS GROUP BY 1",
        "child_rollup": "SELECT o_orderkey, CAST(coalesce(max(l_linenumber), 0) AS INTEGER) AS depth, coalesce(bool_or(l_returnflag = 'R' OR l_linestatus = 'O'), false) AS runs, coalesce(bool_or(l_linenumber >= 2 AND (l_returnflag = 'R' OR l_linestatus = 'O')), false) AS nested FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
        "flow_split_counts": f"WITH {COLLECTED} SELECT job_id, " + ", ".join(f"count(*) FILTER (event_type {c} AND k <= {CAP}) AS n_{n}" for n, c in (("dns", "= 'click'"), ("http", "= 'purchase'"), ("tcp", "NOT IN ('click', 'purchase')"))) + " FROM r GROUP BY 1",
        "contacted_users": f"WITH {COLLECTED}, h AS (SELECT DISTINCT job_id, CASE event_type WHEN 'click' THEN 'd' || event_id % 50 || '.example' WHEN 'purchase' THEN 'h' || event_id % 20 || '.example' END AS h FROM r) SELECT job_id, coalesce(string_agg(h, ',' ORDER BY h), '') AS hosts FROM h GROUP BY 1",
        "flow_distinct_first": f"WITH {COLLECTED}, d AS (SELECT job_id, 'd' || event_id % 50 || '.example' AS qname, min(event_id) AS e FROM r WHERE event_type = 'click' AND k <= {CAP} GROUP BY 1, 2) SELECT job_id, qname, CAST(e AS VARCHAR) AS answer FROM d",
        "rules_fired": f"WITH {JUDGED} SELECT o_orderkey, ids, score, {LEVEL} AS level, CASE WHEN top IS NULL THEN 0.5 ELSE confidence END AS confidence FROM v LEFT JOIN (VALUES {conf}) AS c(top, strong, confidence) USING (top, strong)",
        "signature_topk": f"WITH {JUDGED} SELECT o_orderkey, k AS rank, id, CAST(sev AS INTEGER) AS severity FROM s WHERE k <= 3",
        # Every literal of a text reads back joined, and the whole reversed; what would end a literal was replaced.
        "deobfuscate": f"SELECT doc_id, CASE WHEN length(s) >= 6 THEN s ELSE '' END AS joined, CASE WHEN length(s) >= 6 THEN array_to_string(list_reverse(string_split(s, '')), '') ELSE '' END AS reversed FROM (SELECT doc_id, replace(replace(text, '\"', chr(39)), chr(10), ' ') AS s FROM {DOCS})",
    }
