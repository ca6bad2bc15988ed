"""Main text of web pages by wrappers inferred from pages of one host.

A page becomes a tree of block elements. A wrapper is a union-free regular expression over such trees: a sequence of
elements, each once (``1``), optional (``?``), repeated (``+``) or both (``*``), groups of them repeated together, and text
slots. It starts as one page; every further page of the host is aligned with it, child by child: equal elements are
merged, neighbours that repeat become repeated groups, elements that only one side has become optional, and what comes back
without a period becomes a repeated group of optional elements. Partial wrappers are made where the pages lie, then merged by
(host, salt) and by host, so no task collects a host's pages.

Which texts are a template's is counted before that, over all pages: a text is the same if it stands in its place on at least
``SAME_PERCENT`` of the host's different pages (those of different free text, so copies of one page count once), of which there must be
``SAME_PAGES``, and ``INSIDE_PAGES`` for a text within ``article`` or ``main``. The counts are keyed by host and text, so no task holds
a host. A wrapper's size depends on the templates of the host, not on its pages.

The wrapper then says which paths hold the article. Texts that are the same are left out, and count for nothing; so are parts that the
meaning of their elements or roles gives away (menus, footers, forms). The article is ``main`` or ``article`` if the wrapper has it,
else the smallest element that holds most of the free text. Names (class and id) and shares of links break ties: outside an article
either of them is enough to leave a part out, inside one it takes the name of an advert, a notice or comments, or both. A page is read
by the paths of its host's wrapper, and by its own if none of them leads to text in it.

Null html: empty text. A null or odd url belongs to the host ``""``. Repeated rows give one row each. Extra columns are
left out. Unclosed and crossed tags are read as browsers do: a block start ends a paragraph, an end tag without a start
is ignored, and what is open at the end is closed. Below ``DEEPEST`` nested elements, text belongs to the last of them.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SALTS, FLUSH_HOSTS, DEEPEST = 32, 512, 150
#: Rules of all hosts that are broadcast, in bytes; more of them are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
SAME_PAGES, INSIDE_PAGES, SAME_PERCENT = 3, 10, 95
BLOCKS = frozenset("html body main article section div header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary fieldset legend hr center dialog menu noscript iframe select option button textarea label template svg video audio object canvas title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose text is never a page's own.
NEVER = frozenset("nav footer aside form noscript iframe select option button textarea template svg video audio object canvas title dialog menu label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words in class or id that name what isn't the article.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist respond replies reply disqus discussion notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget widgets search pagination pager toolbar copyright disclaimer alert skip tags".split())
#: Those that name what is no article even inside one.
FOREIGN = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar breadcrumb breadcrumbs comment comments commentlist respond replies reply disqus notice notices cookie cookies consent gdpr popup modal newsletter subscribe subscription".split())
BODIES = frozenset("article content post entry story main body text".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*?)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _key(tag: str, attrs: str) -> str:
    found = {}
    for m in _ATTR.finditer(attrs) if attrs else ():
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    out = tag
    for a, mark in (("role", "@"), ("itemprop", "!"), ("id", "#"), ("class", ".")):
        if found.get(a):
            out += "".join(mark + re.sub(r"\d+", "0", x.replace("/", "_")) for x in sorted(set(found[a].split())))
    return out


def parse(page: str) -> list:
    """The page as nested [key, kids]; a kid is an element or (text, characters of it in links)."""
    root = ["", []]
    stack, tags, link, at = [root], [""], 0, 0

    def say(raw: str) -> None:
        if raw and not raw.isspace():
            text = _html.unescape(raw)
            stack[-1][1].append((text, len(text.strip()) if link else 0))
        elif raw:
            stack[-1][1].append((" ", 0))

    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag == "a":
            link = 0 if m[2] else 1
        if tag == "br":
            stack[-1][1].append((" ", 0))
        if tag not in BLOCKS:
            continue
        if m[2]:
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] == tag:
                    del stack[k:], tags[k:]
                    link = 0
                    break
            continue
        for k in range(len(tags) - 1, 0, -1):  # what this start closes
            if tags[k] in SCOPES.get(tag, ()) or tags[k] in ("body", "article", "section", "main", "div") and tag not in CLOSED_BY:
                break
            if tags[k] == "p" or tags[k] in CLOSED_BY.get(tag, ()):
                del stack[k:], tags[k:]
        node = [_key(tag, m[4]), []]
        stack[-1][1].append(node)
        if tag not in VOID and not m[4].endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
            tags.append(tag)
    say(page[at:])
    return root


def _runs(node: list) -> list[tuple[str, int]]:
    """The texts of an element's own, between its blocks, with the characters of each in links."""
    out, said, linked = [], [], 0
    for k in [*node[1], None]:
        if isinstance(k, tuple):
            said.append(k[0])
            linked += k[1]
            continue
        if text := " ".join("".join(said).split()):
            out.append((text, min(linked, len(text))))
        said, linked = [], 0
    return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _place(path: str, text: str, inside: bool) -> int:
    """A text at its path; odd if that lies within an article."""
    return _hash(f"{path}\n{text}") & ~1 | inside


def _mark(node: list) -> int:
    """A hash of a page's free text."""
    said: list[str] = []

    def walk(n: list) -> None:
        for k in n[1]:
            if isinstance(k, tuple):
                if not k[1]:
                    said.append(k[0])
            elif not _other(k[0]):
                said.append(" ")
                walk(k)
                said.append(" ")

    walk(node)
    return _hash(" ".join("".join(said).split()))


def _inside(key: str) -> bool:
    return _names(key)[0] in ("article", "main")


# A wrapper: [key, times, pages, free characters, of them in links, slot, wrappers of kids]; a repeated group has the key "()". A slot
# holds the hashes of its texts, two of them at most: enough to tell one text from several.
def wrap(node: list, same: frozenset[int] = frozenset(), path: str = "", inside: bool = False) -> list:
    """A page's element as a wrapper; texts among ``same`` count for nothing."""
    here, inside, runs = f"{path}/{node[0]}", inside or _inside(node[0]), _runs(node)
    free = [(t, n) for t, n in runs if _place(here, t, inside) not in same] if same else runs
    slot = sorted({_hash(t) for t, _ in runs})[:2]
    return [node[0], "1", 1, sum(len(t) for t, _ in free), sum(n for _, n in free), slot, fold([wrap(k, same, here, inside) for k in node[1] if isinstance(k, list)])]


def places(node: list, path: str = "", inside: bool = False) -> set[int]:
    """The texts of a page where they stand."""
    here, inside = f"{path}/{node[0]}", inside or _inside(node[0])
    out = {_place(here, t, inside) for t, _ in _runs(node)}
    for k in node[1]:
        if isinstance(k, list):
            out |= places(k, here, inside)
    return out


def _sign(w: list) -> str:
    return w[0] if w[0] != "()" else "(" + " ".join(_sign(k) for k in w[6]) + ")"


def _both(a: str, b: str) -> str:
    return {(False, False): "1", (True, False): "?", (False, True): "+", (True, True): "*"}[a in "?*" or b in "?*", a in "+*" or b in "+*"]


def join(a: list, b: list) -> list:
    """One wrapper for what two wrappers of one key stand for."""
    return [a[0], _both(a[1], b[1]), a[2] + b[2], a[3] + b[3], a[4] + b[4], sorted({*a[5], *b[5]})[:2], align(a[6], b[6])]


def _again(a: list, b: list) -> list:
    out = join(a, b)
    return [out[0], "*" if out[1] in "?*" else "+", *out[2:]]


def _spare(w: list) -> list:
    return [w[0], "*" if w[1] in "+*" else "?", *w[2:]]


def fold(kids: list) -> list:
    """Squares of one to three elements become repeated elements and groups; what comes back without a period, a group of its own."""
    out: list = []
    for w in kids:
        if out and _sign(out[-1]) == _sign(w):
            out[-1] = _again(out[-1], w)
        else:
            out.append(w)
    for period in (2, 3):
        signs, at, done = [_sign(w) for w in out], 0, []
        while at < len(out):
            part = signs[at : at + period]
            end = at + period
            while len(part) == period and signs[end : end + period] == part:
                end += period
            if end > at + period:
                group = out[at : at + period]
                for k in range(at + period, end, period):
                    group = [join(x, y) for x, y in zip(group, out[k : k + period])]
                done.append(["()", "+", (end - at) // period, 0, 0, [], group])
                at = end
            else:
                done.append(out[at])
                at += 1
        out = done
    return irregular(out)


def irregular(kids: list) -> list:
    """From the first to the last of elements that come back three times or more: one repeated group, each of them optional in it.

    So no sequence holds an element more than twice, and its length has a bound in the elements that differ.
    """
    places: dict[str, list[int]] = {}
    for k, w in enumerate(kids):
        for name in _names_in(w):
            places.setdefault(name, []).append(k)
    often = [p for p in places.values() if len(p) > 2]
    if not often:
        return kids
    first, last = min(p[0] for p in often), max(p[-1] for p in often)
    flat: dict[str, list] = {}
    todo = kids[first : last + 1]
    while todo:
        w = todo.pop(0)
        if w[0] == "()":
            todo[:0] = w[6]
        else:
            flat[w[0]] = _again(flat[w[0]], w) if w[0] in flat else w
    return [*kids[:first], ["()", "+", 1, 0, 0, [], [_spare(w) for _, w in sorted(flat.items())]], *kids[last + 1 :]]


def _names_in(w: list) -> set[str]:
    return {w[0]} if w[0] != "()" else set().union(*(_names_in(k) for k in w[6]))


def align(a: list, b: list) -> list:
    """Two sequences as one: the longest common subsequence is merged, the rest is optional."""
    x, y = [_sign(w) for w in a], [_sign(w) for w in b]
    if x == y:
        return [join(p, q) for p, q in zip(a, b)]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append(join(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j >= len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            out.append(_spare(a[i]))
            i += 1
        else:
            out.append(_spare(b[j]))
            j += 1
    return fold(out)


def expression(w: list) -> str:
    """The wrapper in the usual notation of regular expressions."""
    inner = " ".join(expression(k) for k in w[6])
    text = ("", "#same", "#text")[len(w[5])]
    body = " ".join(x for x in (text, inner) if x)
    times = "" if w[1] == "1" else w[1]
    return f"({body}){times}" if w[0] in ("", "()") else f"(<{w[0]}> {body} </>){times}" if body else f"<{w[0]}/>{times}"


def _names(key: str) -> tuple[str, set[str], str]:
    tag = re.split(r"[@!#.]", key, maxsplit=1)[0]
    names = {x for t in re.findall(r"[#.]([^@!#.]+)", key) for x in re.split(r"[-_:]+", t)}
    role = re.search(r"@([^@!#.]+)", key)
    return tag, names, role[1] if role else ""


@lru_cache(maxsize=50_000)
def _other(key: str) -> bool:
    tag, names, role = _names(key)
    return tag in NEVER or role in ROLES or tag not in ("html", "body", "main") and bool(names & FOREIGN)


@lru_cache(maxsize=50_000)
def _named(key: str) -> bool:
    tag, names, _ = _names(key)
    return tag not in ("html", "body", "main", "article") and bool(names & NAMES)


def _out(key: str, inside: bool) -> bool:
    """True for what an element says by itself, inside an article or not."""
    return _other(key) or not inside and (_named(key) or _names(key)[0] == "header")


def _sums(w: list, path: str, out: list, inside: bool) -> tuple[float, float]:
    """Free characters and linked ones below; ``out`` gets (path, wrapper, characters, linked, inside an article)."""
    here = path if w[0] == "()" else f"{path}/{w[0]}"
    inside = inside or _inside(w[0])
    chars, links = w[3], w[4]
    for k in w[6]:
        if not _out(k[0], inside):
            c, n = _sums(k, here, out, inside)
            chars, links = chars + c, links + n
    out.append((here, w, chars, links, inside))
    return chars, links


def rules(wrapper: list) -> dict:
    """Paths of the article's roots and of parts to leave out, as ``wrapper`` says."""
    found: list = []
    _sums(wrapper, "", found, False)
    gone = {p for p, x, c, n, inside in found if x[0] not in ("", "()") and _names(x[0])[0] not in ("html", "body", "main", "article", "p") and c and n > 0.5 * c and (not inside or _named(x[0]))}
    free: dict[str, list] = {}
    for p, x, c, n, *_ in found:
        if x[0] != "()" and not any(p == g or p.startswith(g + "/") for g in gone):
            f = free.setdefault(p, [x[0], 0])
            f[1] += c - n
    total = max((c for _, c in free.values()), default=0)

    def top(paths: list[str]) -> list[str]:
        return sorted(p for p in paths if not any(p.startswith(q + "/") for q in paths))

    mains = [p for p, (k, c) in free.items() if (_names(k)[0] == "main" or _names(k)[2] == "main") and c]
    articles = [p for p, (k, c) in free.items() if (_names(k)[0] == "article" or "!articlebody" in k) and c]
    if mains and sum(free[p][1] for p in top([a for a in articles if any(a.startswith(m + "/") for m in mains)])) >= 0.5 * sum(free[p][1] for p in top(mains)):
        articles = [a for a in articles if any(a.startswith(m + "/") for m in mains)]
        mains = []
    roots = top(mains) or top(articles)
    if not roots and free:
        named = [p for p, (k, c) in free.items() if _names(k)[0] in ("div", "section", "td") and _names(k)[1] & BODIES and c >= 0.5 * total]
        big = named or [p for p, (k, c) in free.items() if c >= 0.7 * total and _names(k)[0] not in ("p", "li", "ul", "ol")]
        roots = [max(big, key=lambda p: (p.count("/"), p))] if big else top(list(free))
    return {"roots": roots, "gone": sorted(gone)}


def read(node: list, rule: dict, same: frozenset[int] = frozenset()) -> str:
    """The article's blocks, one a line."""
    roots, gone, blocks = set(rule["roots"]), set(rule["gone"]), []

    def walk(n: list, path: str, on: bool, inside: bool) -> None:
        inside = inside or _inside(n[0])
        said: list[str] = []

        def end() -> None:
            if on and (text := " ".join("".join(said).split())) and not (same and _place(path, text, inside) in same):
                blocks.append(text)
            said.clear()

        for k in n[1]:
            if isinstance(k, tuple):
                said.append(k[0])
                continue
            end()
            here = f"{path}/{k[0]}"
            if here in gone or _out(k[0], inside):
                continue
            walk(k, here, on or here in roots, inside)
        end()

    walk(node, "/", "/" in roots, False)
    return "\n".join(blocks)


def main_text(page: str | None, rule: dict | None, same: frozenset[int] = frozenset()) -> str:
    if not page:
        return ""
    node = parse(page)
    return (read(node, rule, same) if rule else "") or read(node, rules(wrap(node)))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes = [parse(p) if p else ["", []] for p in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([_mark(n) for n in nodes], pa.int64()), pa.array([sorted(places(n)) for n in nodes], pa.list_(pa.int64()))], ["host", "mark", "places"])


def template_texts(pages: DataFrame) -> DataFrame:
    """(host, same): of each host that has any, the texts that are the same on its pages (host, html), by :func:`_place`.

    No more of them than a page's texts over ``SAME_PERCENT``, whatever the host's pages."""
    said = pages.where("html IS NOT NULL").mapInArrow(_places, "host string, mark long, places array<long>")
    different = cut(said.groupBy("host", "mark").agg(F.min("places").alias("places")))
    total = different.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= SAME_PAGES)
    on = different.select("host", F.explode("places").alias("place")).groupBy("host", "place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAME_PAGES * SAME_PERCENT / 100)
    need = F.when(F.col("place").bitwiseAND(F.lit(1)) == 1, INSIDE_PAGES).otherwise(SAME_PAGES)
    same = on.join(total, "host").where((F.col("pages") >= need) & (100 * F.col("n") >= SAME_PERCENT * F.col("pages")))
    return same.groupBy("host").agg(F.sort_array(F.collect_list("place")).alias("same"))


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def out():
        got = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(map(json.dumps, held.values()), pa.string())], ["host", "wrapper"])
        held.clear()
        return got

    for b in batches:
        for h, page, same in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            if page.is_valid:
                w = wrap(parse(page.as_py()), frozenset(same.as_py() or ()))
                held[h] = join(held[h], w) if h in held else w
                if len(held) > FLUSH_HOSTS:
                    yield out()
    if held:
        yield out()


def _merge(last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by host, so one wrapper is held at a time."""
        host, held = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([json.dumps(held)], pa.string()), *([pa.array([json.dumps(rules(held))], pa.string())] if last else [])], ["host", "wrapper", "rule"][: 2 + last])

        for b in batches:
            for h, w in zip(b.column("host").to_pylist(), b.column("wrapper").to_pylist()):
                if h != host and held is not None:
                    yield out()
                    held = None
                host, held = h, json.loads(w) if held is None else join(held, json.loads(w))
        if held is not None:
            yield out()

    return run


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, rule) of every host of ``pages`` (host, html, same): the wrapper and what it says of the article, both as JSON."""
    parts = pages.select("host", "html", "same").mapInArrow(_infer, "host string, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper")
    some = salted.select("host", "wrapper").mapInArrow(_merge(False), "host string, wrapper string")
    return some.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_merge(True), "host string, wrapper string, rule string")


@lru_cache(maxsize=4_000)
def _rule(said: str) -> dict:
    return json.loads(said)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [main_text(p.as_py(), _rule(r) if r else None, frozenset(s.as_py() or ())) for p, r, s in zip(b.column("html"), b.column("rule").to_pylist(), b.column("same"))]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _beside(pages: DataFrame, found: DataFrame, size: Column) -> DataFrame:
    """``pages`` with what was ``found`` of their hosts. Pages stay where they lie while that is small; beyond ``BROADCAST_BYTES``
    both are shuffled, and AQE splits a busy host's pages."""
    total = found.agg(F.coalesce(F.sum(size + F.length("host")), F.lit(0))).first()[0]
    return pages.join(F.broadcast(found) if total <= BROADCAST_BYTES else found.hint("merge"), "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    same = cut(template_texts(rows.select("host", "html")))
    rows = _beside(rows, same, 8 * F.size("same"))
    found = cut(infer_wrappers(rows).select("host", "rule"))
    return _beside(rows, found, F.length("rule")).select("page_id", "url", "html", "rule", "same").mapInArrow(_read, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extract": op1_html_extract}
SQL: dict[str, str] = {}
