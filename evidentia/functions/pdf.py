"""PDF objects: tokens, cross-references, object streams, and the actions that a document's trees lead to.

A file may be broken on purpose, so each step has a second way: without a usable cross-reference the objects are found by
their headers, without a catalogue every page object counts as a page. Walks keep the objects they have been at, so trees
that loop end; all that is inflated is charged to one budget of bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

#: Bytes that the streams of one document may inflate to, in all; objects that a walk visits; nesting of one object.
MOST_INFLATED, MOST_VISITED, MOST_NESTED = 64 << 20, 100_000, 64
#: Streams shown to the search for keywords.
MOST_STREAMS = 60
SHOWN_OPEN, SHOWN_ACTION, SHOWN_SCRIPT = 1500, 800, 8000

_SPACE, _DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
_TOKEN = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*(<<|>>|[\[\](<{}]|/[^\0\t\n\f\r ()<>\[\]{}/%]*|[^\0\t\n\f\r ()<>\[\]{}/%]+)")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![a-z])")
_REF = re.compile(rb"[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Broken(Exception):
    """What can't be read, in words."""


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    number: int


class Stream(NamedTuple):
    entries: dict
    start: int


class Budget:
    """Bytes that may still be inflated; what doesn't fit is told, once it was refused."""

    def __init__(self, left: int = MOST_INFLATED):
        self.left, self.spent = left, False

    def inflate(self, raw: bytes) -> bytes:
        for bits in (15, -15):  # with a zlib header or without
            flow = zlib.decompressobj(bits)
            try:
                got = flow.decompress(raw, self.left + 1)
            except zlib.error:
                continue
            if len(got) > self.left:
                self.spent, self.left = True, 0
                raise Broken("streams inflate beyond the budget")
            self.left -= len(got)
            return got
        raise Broken("a stream doesn't inflate")


def read(data: bytes, at: int, nested: int = 0):
    """(object, position behind it); ``Name`` and ``Ref`` for names and references, bytes for strings."""
    m = _TOKEN.match(data, at)
    if not m or nested > MOST_NESTED:
        raise Broken("an object ends early or nests too deep")
    token, at = m[1], m.end()
    if token == b"<<":
        out = {}
        while (m := _TOKEN.match(data, at)) and m[1] != b">>":
            key, at = read(data, at, nested + 1)
            if not isinstance(key, Name):
                continue
            m = _TOKEN.match(data, at)
            if m and m[1] == b">>":
                break
            out[key], at = read(data, at, nested + 1)
        return out, m.end() if m else len(data)
    if token == b"[":
        out = []
        while (m := _TOKEN.match(data, at)) and m[1] != b"]":
            value, at = read(data, at, nested + 1)
            out.append(value)
        return out, m.end() if m else len(data)
    if token == b"(":
        return _literal(data, at)
    if token == b"<":
        end = data.find(b">", at)
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at : end if end >= 0 else len(data)])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), (end if end >= 0 else len(data)) + 1
    if token[:1] == b"/":
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), token).decode("latin-1")), at
    if token.isdigit() and len(token) < 11 and (m := _REF.match(data, at)):
        return Ref(int(token)), m.end()
    try:
        return (float(token) if b"." in token else int(token)), at
    except ValueError:
        return {b"true": True, b"false": False}.get(token), at


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    for m in re.compile(rb"[^()\\]+|\\(?:[0-7]{1,3}|\r\n|.)|[()]", re.S).finditer(data, at):
        t = m[0]
        if t[:1] == b"\\":
            rest = t[1:]
            if rest[:1] in b"01234567":
                out.append(int(rest, 8) & 255)
            elif rest[:1] not in b"\r\n":
                out += _ESCAPES.get(rest, rest)
            continue
        depth += (t == b"(") - (t == b")")
        if not depth:
            return bytes(out), m.end()
        out += t
    return bytes(out), len(data)


def text_of(raw: bytes) -> str:
    for mark, coding in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"\xef\xbb\xbf", "utf-8")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(coding, "replace")
    return raw.decode("latin-1")


def _ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~")[0]:
        if c == 122 and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        full = group + [84] * (5 - len(group))
        out += (sum(v * 85 ** (4 - i) for i, v in enumerate(full)) & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def _rows(data: bytes, how: dict) -> bytes:
    """Undoes a predictor of PNG rows, as cross-reference streams use them."""
    if not isinstance(how, dict) or int(how.get("/Predictor") or 1) < 10:
        return data
    bpp = max(1, int(how.get("/Colors") or 1) * int(how.get("/BitsPerComponent") or 8) // 8)
    width = (int(how.get("/Columns") or 1) * int(how.get("/Colors") or 1) * int(how.get("/BitsPerComponent") or 8) + 7) // 8
    out, above = bytearray(), bytes(width)
    for i in range(0, len(data) - width, width + 1):
        kind, row = data[i], bytearray(data[i + 1 : i + 1 + width])
        for j in range(width):
            left, up, corner = (row[j - bpp] if j >= bpp else 0), above[j], (above[j - bpp] if j >= bpp else 0)
            guess = left + up - corner
            near = min((left, up, corner), key=lambda v: abs(guess - v))
            row[j] = (row[j] + {1: left, 2: up, 3: (left + up) // 2, 4: near}.get(kind, 0)) & 255
        out += row
        above = bytes(row)
    return bytes(out)


class Document:
    """Objects by number, read when they are asked for."""

    def __init__(self, data: bytes, budget: Budget | None = None):
        self.data, self.budget = data, budget or Budget()
        self.base = max(0, data.find(b"%PDF-", 0, 1024))  # offsets count from the header
        self.places: dict[int, tuple[int, int]] = {}  # number: (0, offset) or (object stream, index)
        self.known: dict[int, object] = {}
        self.packed: dict[int, list] = {}
        self.trailer: dict = {}
        self.rebuilt = False
        try:
            self._follow()
        except (Broken, ValueError, TypeError, IndexError):
            pass
        if not isinstance(self.get(self.trailer.get("/Root")), dict) or not self._root_is_whole():
            self._rebuild()

    def _root_is_whole(self) -> bool:
        root = self.get(self.trailer.get("/Root"))
        return isinstance(self.get(root.get("/Pages")), dict)

    def _follow(self) -> None:
        """Cross-reference tables and streams from the last to the first; the latest place of an object counts."""
        m = re.compile(rb"startxref[\0\t\n\f\r ]+(\d+)").search(self.data, self.data.rfind(b"startxref"))
        todo, seen = [int(m[1])] if m else [], set()
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at + self.base < len(self.data):
                continue
            seen.add(at)
            at += self.base
            m = _TOKEN.match(self.data, at)
            trailer = self._table(m.end()) if m and m[1] == b"xref" else self._xref_stream(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            todo += [int(trailer[k]) for k in ("/XRefStm", "/Prev") if isinstance(trailer.get(k), (int, float))]

    def _table(self, at: int) -> dict:
        while (m := _TOKEN.match(self.data, at)) and m[1] != b"trailer":
            first, at = read(self.data, at)
            count, at = read(self.data, at)
            if not isinstance(first, int) or not isinstance(count, int):
                raise Broken("a cross-reference table is not one")
            for number in range(first, first + min(count, MOST_VISITED)):
                m = re.compile(rb"[\0\t\n\f\r ]*(\d{1,10})[ ]+(\d{1,5})[ ]+([nf])").match(self.data, at)
                if not m:
                    raise Broken("a cross-reference entry is not one")
                at = m.end()
                if m[3] == b"n":
                    self.places.setdefault(number, (0, int(m[1])))
                else:
                    self.places.setdefault(number, (0, -1))
        if not m:
            raise Broken("no trailer")
        trailer = read(self.data, m.end())[0]
        return trailer if isinstance(trailer, dict) else {}

    def _xref_stream(self, at: int) -> dict:
        _, found = self._object_at(at)
        if not isinstance(found, Stream):
            raise Broken("no cross-reference where one should be")
        e, raw = found.entries, self.bytes_of(found)
        a, b, c = (int(x) for x in e["/W"])
        index = e.get("/Index") or [0, int(e["/Size"])]
        at, step = 0, a + b + c
        for first, count in zip(index[::2], index[1::2]):
            for number in range(first, first + min(count, (len(raw) - at) // max(step, 1))):
                row = raw[at : at + step]
                at += step
                kind = int.from_bytes(row[:a], "big") if a else 1
                x, y = int.from_bytes(row[a : a + b], "big"), int.from_bytes(row[a + b :], "big")
                self.places.setdefault(number, {0: (0, -1), 1: (0, x), 2: (x, y)}.get(kind, (0, -1)))
        return e

    def _rebuild(self) -> None:
        """Objects by their headers, the last of a number; and those packed into the object streams among them."""
        self.rebuilt, self.known, self.packed = True, {}, {}
        self.places = {int(m[1]): (0, m.start() - self.base) for m in _OBJECT.finditer(self.data)}
        trailers = []
        for m in re.finditer(rb"trailer", self.data):
            try:
                trailers.append(read(self.data, m.end())[0])
            except Broken:
                continue
        for number in [*self.places]:
            found = self.get(Ref(number))
            if isinstance(found, Stream) and found.entries.get("/Type") == "/ObjStm":
                for i, (inner, _) in enumerate(self._unpacked(number)):
                    self.places.setdefault(inner, (number, i))
            elif isinstance(found, Stream) and found.entries.get("/Type") == "/XRef":
                trailers.append(found.entries)
        for t in trailers:
            if isinstance(t, dict):
                self.trailer.update({k: v for k, v in t.items() if k != "/Root" or isinstance(self.get(v), dict)})
        if not isinstance(self.get(self.trailer.get("/Root")), dict):
            self.trailer["/Root"] = next((Ref(n) for n in reversed([*self.places]) if isinstance(o := self.get(Ref(n)), dict) and o.get("/Type") == "/Catalog"), None)

    def _object_at(self, at: int):
        m = _OBJECT.match(self.data, _TOKEN.match(self.data, at).start(1)) if _TOKEN.match(self.data, at) else None
        if not m:
            raise Broken("no object where one should be")
        found, end = read(self.data, m.end())
        m2 = re.compile(rb"[\0\t\n\f\r ]*stream(\r\n|\n|\r)?").match(self.data, end)
        return int(m[1]), Stream(found, m2.end()) if m2 and isinstance(found, dict) else found

    def _unpacked(self, number: int) -> list[tuple[int, object]]:
        """(number, object) of an object stream."""
        if number not in self.packed:
            self.packed[number] = []
            holder = self.get(Ref(number))
            if isinstance(holder, Stream):
                try:
                    raw = self.bytes_of(holder)
                    n, first = int(self.get(holder.entries.get("/N"))), int(self.get(holder.entries.get("/First")))
                    heads = [int(x) for x in raw[:first].split()[: 2 * n]]
                    for inner, at in zip(heads[::2], heads[1::2]):
                        self.packed[number].append((inner, read(raw, first + at)[0]))
                except (Broken, ValueError, TypeError):
                    pass
        return self.packed[number]

    def get(self, x, hops: int = 16):
        """What ``x`` stands for; None if it leads nowhere or in a circle."""
        while isinstance(x, Ref) and hops:
            hops -= 1
            if x.number not in self.known:
                self.known[x.number] = None  # an object that needs itself has no value
                holder, at = self.places.get(x.number, (0, -1))
                if holder:
                    self.known[x.number] = next((o for n, o in self._unpacked(holder) if n == x.number), None)
                elif at >= 0:
                    try:
                        number, found = self._object_at(at + self.base)
                        self.known[x.number] = found if number == x.number else None
                    except (Broken, RecursionError):
                        pass
            x = self.known[x.number]
        return None if isinstance(x, Ref) else x

    def bytes_of(self, s: Stream) -> bytes:
        size = self.get(s.entries.get("/Length"))
        end = s.start + size if isinstance(size, int) and 0 <= size <= len(self.data) - s.start else -1
        if end < 0 or b"endstream" not in self.data[end : end + 20]:
            end = self.data.find(b"endstream", s.start)
            end = len(self.data) if end < 0 else end
        raw = self.data[s.start : end]
        listed = lambda v: v if isinstance(v, list) else [v]
        filters = listed(self.get(s.entries.get("/Filter") or s.entries.get("/F")))
        hows = listed(self.get(s.entries.get("/DecodeParms") or s.entries.get("/DP")))
        for i, f in enumerate(filters):
            f = self.get(f)
            if f in ("/FlateDecode", "/Fl"):
                raw = _rows(self.budget.inflate(raw), self.get(hows[i]) if i < len(hows) else None)
            elif f in ("/ASCIIHexDecode", "/AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw.split(b">")[0])
                raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif f in ("/ASCII85Decode", "/A85"):
                raw = _ascii85(raw)
            elif f is not None:
                raise Broken(f"no reader for {f}")
        return raw

    def show(self, x, nested: int = 0) -> str:
        """An object as PDF text, references replaced by what they stand for, six deep."""
        if isinstance(x, Ref):
            x = self.get(x) if nested < 6 else x
        if isinstance(x, Stream):
            return self.show(x.entries, nested) + " stream"
        if isinstance(x, Ref):
            return f"{x.number} 0 R"
        if isinstance(x, dict):
            return "<< " + "".join(f"{k} {'...' if k == '/Parent' else self.show(v, nested + 1)} " for k, v in x.items()) + ">>"
        if isinstance(x, list):
            return "[ " + "".join(self.show(v, nested + 1) + " " for v in x[:200]) + "]"
        if isinstance(x, bytes):
            return f"({text_of(x)})"
        return {True: "true", False: "false", None: "null"}.get(x, str(x)) if isinstance(x, (bool, type(None))) else str(x)

    def text(self, x) -> str:
        x = self.get(x)
        if isinstance(x, Stream):
            return self.bytes_of(x).decode("utf-8", "replace")
        return text_of(x) if isinstance(x, bytes) else "" if x is None else str(x)

    def _tree(self, root, kids: str) -> Iterator[dict]:
        """Nodes of a tree, depth first, in order; a node that comes back is passed over."""
        stack, seen = [root], set()
        while stack and len(seen) < MOST_VISITED:
            x = stack.pop()
            if isinstance(x, Ref):
                if x in seen:
                    continue
                seen.add(x)
            node = self.get(x)
            if isinstance(node, dict):
                yield node
                below = self.get(node.get(kids))
                stack += reversed(below) if isinstance(below, list) else []

    def pages(self) -> list[dict]:
        root = self.get(self.trailer.get("/Root"))
        found = [n for n in self._tree(root.get("/Pages"), "/Kids") if n.get("/Type") == "/Page" or ("/Kids" not in n and "/Type" not in n)] if isinstance(root, dict) and "/Pages" in root else []
        if not found and self.rebuilt:
            found = [o for n in sorted(self.places) if isinstance(o := self.get(Ref(n)), dict) and o.get("/Type") == "/Page"]
        return found

    def names(self, tree: str) -> Iterator[tuple[str, object]]:
        """(name, value) of a name tree of the document."""
        root = self.get(self.trailer.get("/Root"))
        names = self.get(root.get("/Names")) if isinstance(root, dict) else None
        for node in self._tree(names.get(tree), "/Kids") if isinstance(names, dict) else ():
            pairs = self.get(node.get("/Names"))
            if isinstance(pairs, list):
                yield from ((self.text(k), v) for k, v in zip(pairs[::2], pairs[1::2]))

    def actions(self, *starts) -> Iterator[dict]:
        """Actions, and those that follow them."""
        stack, seen = [*reversed(starts)], set()
        while stack and len(seen) < MOST_VISITED:
            x = stack.pop()
            key = x if isinstance(x, Ref) else id(x)
            found = self.get(x)
            if key in seen or not isinstance(found, (dict, list)):
                continue
            seen.add(key)
            if isinstance(found, list):
                stack += [v for v in reversed(found) if isinstance(v, (Ref, dict))]
            else:
                yield found
                stack += [found["/Next"]] if "/Next" in found else []


def triggers(doc: Document, holder: dict, *keys: str) -> list:
    """Actions at ``keys`` of a dictionary; those of an additional-actions dictionary one by one."""
    out = []
    for k in keys:
        value = doc.get(holder.get(k))
        out += value.values() if k == "/AA" and isinstance(value, dict) else [holder[k]] if k in holder else []
    return out


def structure(data: bytes, entropy_of: Callable[[bytes], float], budget: Budget | None = None) -> dict:
    """What a document's catalogue, pages, annotations, form fields and name trees hold; ``error`` tells what couldn't be read."""
    doc = Document(data, budget)
    root = doc.get(doc.trailer.get("/Root"))
    root = root if isinstance(root, dict) else {}
    pages = doc.pages()
    m = re.match(rb"%PDF-(\d+\.\d+)", data[doc.base :])
    version = (root.get("/Version") or "")[1:] or (m[1].decode() if m else "")
    out = {"parsed": bool(root or pages), "version": version, "encrypted": "/Encrypt" in doc.trailer, "pages": len(pages), "javascript": [], "embedded_files": [], "open_action": None, "launch_actions": [], "uris": [], "page_actions": [], "error": None}
    if "/OpenAction" in root:
        out["open_action"] = doc.show(root["/OpenAction"])[:SHOWN_OPEN]
    starts = triggers(doc, root, "/OpenAction", "/AA") + [v for _, v in doc.names("/JavaScript")]
    for number, page in enumerate(pages, 1):
        out["page_actions"] += [{"page": number, "key": k, "value": doc.show(page[k])[:SHOWN_ACTION]} for k in ("/AA", "/OpenAction") if k in page]
        starts += triggers(doc, page, "/AA", "/OpenAction")
        notes = doc.get(page.get("/Annots"))
        for note in map(doc.get, notes if isinstance(notes, list) else ()):
            starts += triggers(doc, note, "/A", "/AA") if isinstance(note, dict) else []
    form = doc.get(root.get("/AcroForm"))
    fields = doc.get(form.get("/Fields")) if isinstance(form, dict) else None
    for field in (n for f in (fields if isinstance(fields, list) else ()) for n in doc._tree(f, "/Kids")):
        starts += triggers(doc, field, "/A", "/AA")
    for action in doc.actions(*starts):
        kind = doc.get(action.get("/S"))
        try:
            if kind == "/Launch":
                out["launch_actions"].append(doc.show(action)[:SHOWN_ACTION])
            elif kind == "/URI":
                out["uris"].append(doc.text(action.get("/URI")))
            if "/JS" in action:
                out["javascript"].append(doc.text(action["/JS"])[:SHOWN_SCRIPT])
        except Broken as e:
            out["error"] = str(e)
    for name, spec in doc.names("/EmbeddedFiles"):
        spec, size, bits = doc.get(spec), None, None
        held = doc.get(spec.get("/EF")) if isinstance(spec, dict) else None
        stream = doc.get(held.get("/F") or held.get("/UF")) if isinstance(held, dict) else None
        if isinstance(stream, Stream):
            try:
                body = doc.bytes_of(stream)
                size, bits = len(body), entropy_of(body[:65536])
            except Broken as e:
                out["error"] = str(e)
        out["embedded_files"].append({"name": name, "size": size, "entropy": bits})
    for k in ("uris", "javascript", "launch_actions"):
        out[k] = list(dict.fromkeys(x for x in out[k] if x))[:100]
    if doc.budget.spent:
        out["error"] = "streams inflate beyond the budget"
    elif not out["parsed"]:
        out["error"] = "no objects could be read"
    elif out["encrypted"]:
        out["error"] = "the document is encrypted, its strings were not read"
    return out


def streams(data: bytes, budget: Budget) -> list[bytes]:
    """Streams that inflate, in the file's order, whether or not an object leads to them."""
    out, at = [], 0
    mark = re.compile(rb"(?<!end)stream(?:\r\n|\n|\r)?")
    while len(out) < MOST_STREAMS and (m := mark.search(data, at)):
        end = data.find(b"endstream", m.end())
        if end < 0:
            break
        try:
            out.append(budget.inflate(data[m.end() : end]))
        except Broken:
            if budget.spent:
                break
        at = end + 9
    return out
