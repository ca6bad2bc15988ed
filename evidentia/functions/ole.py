"""OLE compound files: sector chains, the directory tree, and the modules of a VBA project.

Chains are followed through their allocation tables, so a stream's sectors may lie anywhere; a chain or tree that loops
ends where it would come back. Modules come from the project's ``dir`` stream: which stream holds each, and where in it its source
begins. Where that stream is damaged, on purpose or not, every stream is searched for compressed source instead.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
MOST_ENTRIES, MOST_MODULES = 20_000, 60
#: Ids of records in a ``dir`` stream.
VERSION, CODE_PAGE, MODULE_NAME, MODULE_STREAM, MODULE_OFFSET = 0x0009, 0x0003, 0x0019, 0x001A, 0x0031


class Broken(Exception):
    """What can't be read, in words."""


class Compound:
    """Streams of a compound file by path."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise Broken("no compound file")
        self.data, self.missing = data, 0
        self.shift, mini = struct.unpack_from("<HH", data, 30)
        if self.shift not in (9, 12) or mini != 6:
            raise Broken("sector sizes that don't exist")
        first_dir, self.small = struct.unpack_from("<I4xI", data, 48)
        first_mini, _, at, more = struct.unpack_from("<IIII", data, 60)
        tables = [x for x in struct.unpack_from("<109I", data, 76) if x < END]
        seen = set()
        while at < END and at not in seen and len(seen) <= more:  # further lists of tables, each ending in the next
            seen.add(at)
            part = self._numbers(self._sector(at))
            tables += [x for x in part[:-1] if x < END]
            at = part[-1] if part else END
        self.fat = [x for t in tables for x in self._numbers(self._sector(t))]
        self.mini_fat = self._numbers(self._chain(first_mini)) if first_mini < END else []
        self.entries = self._directory(self._chain(first_dir))
        self.mini = self._chain(self.entries[0][3])[: self.entries[0][4]] if self.entries else b""
        self.paths = self._walk()

    def _sector(self, n: int) -> bytes:
        found = self.data[(n + 1) << self.shift : (n + 2) << self.shift]
        self.missing += not found
        return found

    @staticmethod
    def _numbers(raw: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    def _chain(self, at: int, limit: int | None = None) -> bytes:
        out, seen, size = [], set(), 0
        while at < END and at not in seen and at < len(self.fat) and (limit is None or size < limit):
            seen.add(at)
            out.append(self._sector(at))
            size += len(out[-1])
            at = self.fat[at]
        return b"".join(out)

    def _directory(self, raw: bytes) -> list[tuple]:
        """(name, kind, (left, right, child), first sector, size)."""
        out = []
        for i in range(0, min(len(raw) // 128, MOST_ENTRIES) * 128, 128):
            length, kind = struct.unpack_from("<HB", raw, i + 64)
            size = struct.unpack_from("<Q", raw, i + 120)[0] if self.shift == 12 else struct.unpack_from("<I", raw, i + 120)[0]
            name = raw[i : i + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
            out.append((name, kind, struct.unpack_from("<III", raw, i + 68), struct.unpack_from("<I", raw, i + 116)[0], size))
        return out

    def _walk(self) -> dict[str, int]:
        """Paths of streams; each entry is visited once."""
        found, seen = {}, {0}
        todo = [(self.entries[0][2][2], "")] if self.entries else []
        while todo:
            n, folder = todo.pop()
            if n in seen or n >= len(self.entries):
                continue
            seen.add(n)
            name, kind, (left, right, child), _, _ = self.entries[n]
            todo += [(right, folder), (left, folder)]
            if kind == 1:
                todo.append((child, f"{folder}{name}/"))
            elif kind == 2:
                found[folder + name] = n
        return found

    def stream(self, path: str) -> bytes:
        _, _, _, at, size = self.entries[self.paths[path]]
        if size >= self.small:
            return self._chain(at, size)[:size]
        out, seen = [], set()
        while at < END and at not in seen and at < len(self.mini_fat) and len(out) * 64 < size:
            seen.add(at)
            out.append(self.mini[at * 64 : at * 64 + 64])
            at = self.mini_fat[at]
        return b"".join(out)[:size]


def modules(directory: bytes) -> tuple[str, list[dict]]:
    """(coding, modules with ``name``, ``stream`` and ``offset``) of an unpacked ``dir`` stream."""
    out, coding, at = [], "latin-1", 0
    while at + 6 <= len(directory):
        kind, size = struct.unpack_from("<HI", directory, at)
        body = directory[at + 6 : at + 6 + size]
        if len(body) < size:
            raise Broken("a record of the project's directory ends early")
        if kind == CODE_PAGE and size == 2:
            page = struct.unpack("<H", body)[0]
            coding = {65001: "utf-8", 10000: "mac-roman"}.get(page, f"cp{page}")
        elif kind == MODULE_NAME:
            out.append({"name": body, "stream": None, "offset": None})
        elif kind == MODULE_STREAM and out:
            out[-1]["stream"] = body
        elif kind == MODULE_OFFSET and size == 4 and out:
            out[-1]["offset"] = struct.unpack("<I", body)[0]
        at += 6 + size + (2 if kind == VERSION else 0)  # its size leaves out the minor version
    try:
        "".encode(coding)
    except LookupError:
        coding = "latin-1"
    for m in out:
        m.update(name=m["name"].decode(coding, "replace"), stream=(m["stream"] or m["name"]).decode(coding, "replace"))
    return coding, out


def macros(data: bytes, unpack: Callable[[bytes], bytes], search: Callable[[bytes], list[tuple[str, str]]]) -> tuple[list[tuple[str, str, str]], str | None]:
    """((stream, name, source) of each module, what couldn't be read). ``unpack`` opens a compressed container, ``search``
    finds (name, source) of containers anywhere in bytes."""
    file = Compound(data)
    out, error, read = [], None, set()
    for path in file.paths:
        folder, _, name = path.rpartition("/")
        if name.lower() != "dir" or folder.rpartition("/")[2].lower() != "vba":
            continue
        try:
            coding, known = modules(unpack(file.stream(path)))
        except Broken as e:
            error = str(e)
            continue
        for m in known[:MOST_MODULES]:
            where = f"{folder}/{m['stream']}"
            source = unpack(file.stream(where)[m["offset"] :]) if where in file.paths and m["offset"] is not None else b""
            if source:
                read.add(where)
                out.append((where, m["name"], source.decode(coding, "replace")))
            else:
                error = f"module {m['name']} has no source where its project says"
    for path in file.paths:
        if path not in read and len(out) < MOST_MODULES:
            out += [(path, name or "(recovered)", code) for name, code in search(file.stream(path))]
    return out, error or (f"{file.missing} sectors are missing" if file.missing else None)
