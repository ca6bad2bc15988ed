"""Content functions as Column expressions: indicators, strings, deobfuscation, keywords, defanging.

Byte scans read binary as ISO-8859-1, so a character is a byte and ``\\b`` is spelled with ASCII classes, as Java's is
Unicode-aware. Lists keep the order of first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

WORD = "A-Za-z0-9_"
#: Four printable bytes, then up to the first terminator: what a lazy match with a lookahead takes.
URL = rf"(?i)(?<![{WORD}])((?:https?|ftp|file)://[!-~]{{4}}[!#-&(*+\-./0-:=?-\[^-|~]*)"
DOMAIN = rf"(?i)(?<![{WORD}])((?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+(?:{dims.DOMAIN_TLDS}))(?![{WORD}])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![{WORD}])({OCTET}(?:\.{OCTET}){{3}})(?![{WORD}])"
EMAIL = rf"(?i)(?<![{WORD}])([a-z0-9._%+-]{{1,64}}@[a-z0-9.-]{{1,255}}\.[a-z]{{2,24}})(?![{WORD}])"
BASE64 = r"(?<![A-Za-z0-9+/])([A-Za-z0-9+/]{40,}={0,2})(?![A-Za-z0-9+/])"


def array_of(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def latin1(content: Column) -> Column:
    """Bytes as text of one character each."""
    return F.decode(content, "ISO-8859-1")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def distinct(items: Column, limit: int) -> Column:
    """First occurrences, in order, at most ``limit``."""
    return F.slice(F.array_distinct(items), 1, limit)


def urls(text: Column, limit: int = 200) -> Column:
    return distinct(F.transform(found(text, URL), lambda u: F.regexp_replace(u, "[.,;]+$", "")), limit)


def is_benign_domain(host: Column) -> Column:
    return F.exists(array_of(dims.BENIGN_DOMAINS), lambda b: (host == b) | F.endswith(host, F.concat(F.lit("."), b)))


def domains(text: Column, limit: int = 200) -> Column:
    return distinct(F.filter(F.transform(found(text, DOMAIN), F.lower), lambda h: ~is_benign_domain(h)), limit)


def ips(text: Column, limit: int = 200) -> Column:
    return distinct(F.filter(found(text, IPV4), lambda i: ~i.isin(dims.BENIGN_IPS)), limit)


def emails(text: Column, limit: int = 200) -> Column:
    return distinct(F.transform(found(text, EMAIL), F.lower), limit)


def iocs(text: Column, limit: int = 200) -> Column:
    return F.struct(urls(text, limit).alias("urls"), domains(text, limit).alias("domains"), ips(text, limit).alias("ips"), emails(text, limit).alias("emails"))


def merge_iocs(*sources: Column, cap: int = 150) -> Column:
    """Indicators of several sources in order of first occurrence, empty ones left out, each kind capped."""

    def kind(k: str) -> Column:
        lists = [F.coalesce(s[k], F.array().cast("array<string>")) for s in sources]
        return distinct(F.filter(F.concat(*lists), lambda v: v.isNotNull() & (v != "")), cap).alias(k)

    return F.struct(*[kind(k) for k in ("urls", "domains", "ips", "emails")])


def strings(text: Column, least: int = 6, limit: int = 400) -> Column:
    """Printable ASCII runs, then UTF-16LE runs, of latin-1 text."""
    wide = F.transform(found(text, rf"((?:[\x20-\x7e]\x00){{{least},}})"), lambda s: F.replace(s, F.lit("\0"), F.lit("")))
    return distinct(F.concat(found(text, rf"([\x20-\x7e]{{{least},}})"), wide), limit)


def truncate(value: Column, limit: int = 4000) -> Column:
    more = F.concat(F.substring(value, 1, limit), F.lit("\n...[truncated "), (F.length(value) - limit).cast("string"), F.lit(" chars]"))
    return F.when(F.length(value) <= limit, value).otherwise(more)


def keyword_hits(text: Column, words) -> Column:
    """Keywords that the lower-cased text holds as substrings, in the list's order."""
    low = F.lower(text)
    return F.filter(array_of(words), lambda k: F.contains(low, k))


def keyword_meanings(text: Column, meanings: dict[str, str], key: str = "keyword") -> Column:
    low = F.lower(text)
    rows = F.array(*[F.struct(F.lit(k).alias(key), F.lit(v).alias("meaning")) for k, v in meanings.items()])
    return F.filter(rows, lambda r: F.contains(low, r[key]))


def auto_exec(code: Column) -> Column:
    return F.array_sort(keyword_hits(code, dims.AUTO_EXEC))


def count_of(text: Column, word: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def keyword_counts(text: Column, meanings: dict[str, str]) -> Column:
    """Map from each keyword in the text to its count and meaning."""
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.struct(count_of(text, k).alias("count"), F.lit(v).alias("meaning")).alias("value")) for k, v in meanings.items()])
    return F.map_from_entries(F.filter(rows, lambda r: r["value"]["count"] > 0))


def longest_line(text: Column) -> Column:
    lines = F.split(text, "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]")
    return F.array_max(F.transform(lines, F.length))


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def printable_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\x20-\\x7E\\t\\n\\r]", "")) / F.length(text)


def is_text(head: Column) -> Column:
    """No NUL in the first 1,024 characters and more than nine tenths printable."""
    return F.coalesce(~F.contains(F.substring(head, 1, 1024), F.lit("\0")) & (F.length(head) > 0) & (printable_ratio(head) > 0.9), F.lit(False))


# ---- deobfuscation
def reversed_literals(text: Column) -> Column:
    return F.transform(found(text, r'(?i)"([^"\n]{6,})"\s*\.\s*split\(\s*""\s*\)\s*\.\s*reverse'), F.reverse)


def str_reverse(code: Column) -> Column:
    return F.transform(found(code, r'(?i)StrReverse\s*\(\s*"([^"]{4,})"\s*\)'), F.reverse)


def joined_literals(text: Column, operator: str, piece: int, least: int) -> Column:
    """Literals joined by ``operator`` ("+" or "&"), put together."""
    runs = found(text, rf'("[^"\n]{{0,{piece}}}"(?:\s*[{operator}]\s*"[^"\n]{{0,{piece}}}")++)')  # possessive: no recursion over thousands of literals
    return F.filter(F.transform(runs, lambda r: F.array_join(found(r, r'"([^"\n]*)"'), "")), lambda s: F.length(s) >= least)


def hex_escapes(text: Column) -> Column:
    return F.transform(found(text, r'"((?:\\x[0-9a-fA-F]{2}){4,})"'), lambda m: F.make_valid_utf8(F.unhex(F.replace(m, F.lit("\\x"), F.lit(""))).cast("string")))


def base64_blobs(text: Column) -> Column:
    return found(text, BASE64)


def script_language(head: Column) -> Column:
    """Script family by content; null for none."""
    low, out = F.lower(F.substring(head, 1, 4096)), None
    for family, pattern in dims.SCRIPT_CONTENT:
        out = F.when(low.rlike(pattern), family) if out is None else out.when(low.rlike(pattern), family)
    return out


# ---- indicators in reports
def defang(value: Column) -> Column:
    """Links made inert: schemes altered, dots of their hosts and of IPv4 addresses bracketed; bare domains stay as they are.

    A text is cut behind each ``://``; a piece that follows a scheme starts with a host, whose dots are bracketed once.
    """
    scheme = r"(?iU)\b(?:h[xt]{2}ps?|f[xt]p)://$"

    def piece(parts: Column, p: Column, i: Column) -> Column:
        host = F.regexp_extract(p, r"^[^/\s:]{0,256}", 0)
        led = (i > 0) & F.coalesce(F.substring(F.get(parts, i - 1), -9, 9).rlike(scheme), F.lit(False))
        return F.when(led & F.contains(host, F.lit(".")), F.concat(F.replace(host, F.lit("."), F.lit("[.]")), F.substr(p, F.length(host) + 1))).otherwise(p)

    altered = F.regexp_replace(F.regexp_replace(value, r"(?U)\bhttp(s?)://", "hxxp$1://"), r"(?U)\bftp://", "fxp://")
    linked = _let(F.split(altered, "(?<=://)"), lambda parts: F.array_join(F.transform(parts, lambda p, i: piece(parts, p, i)), ""))
    out = F.when(F.contains(value, F.lit("://")), linked).otherwise(value)
    return F.regexp_replace(out, r"(?U)\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b", "$1[.]$2[.]$3[.]$4")


def defang_host(host: Column) -> Column:
    all_dots = host.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    return F.when(all_dots, F.replace(host, F.lit("."), F.lit("[.]"))).otherwise(F.regexp_replace(host, r"\.([^.]*)$", "[.]$1"))


def is_infra_ip(ip: Column, *more: Column) -> Column:
    """The sandbox's own addresses: loopback, its subnet, its resolver and worker."""
    out = ip.isin("127.0.0.11", "0.0.0.0") | F.startswith(ip, F.lit("127.")) | F.startswith(ip, F.lit("172.31.240."))
    for m in more:
        out = out | F.coalesce((m != "") & (ip == m), F.lit(False))
    return F.coalesce(out, F.lit(False))


def is_remote_ip(ip: Column) -> Column:
    """Not private, loopback, link-local, multicast, documentation, nor like a version number."""
    o = F.transform(F.split(ip, "\\."), lambda x: x.try_cast("int"))
    a, b, c, d = (F.get(o, F.lit(i)) for i in range(4))
    special = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a == 127) | ((a == 169) & (b == 254)) | a.isin(224, 239, 240, 255)
    example = ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    version = (a < 10) & (b < 10) & (c < 10) & (d < 10)
    return F.coalesce((F.size(o) == 4) & ~special & ~example & ~version, F.lit(False))
