"""Disc images (ISO 9660, with Joliet names) and cabinets: what they list and hold, read without outside tools."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

SECTOR = 2048
MOST_LISTED = 20_000


class Broken(Exception):
    """What can't be read, in words."""


class Entry(NamedTuple):
    name: str
    size: int
    is_dir: bool
    #: Where its bytes are: pieces of the image, or a folder of the cabinet and an offset in it.
    at: tuple


class Image:
    """An ISO 9660 image; of its volumes, the one with Joliet names if there is one."""

    def __init__(self, data: bytes):
        self.data, root = data, None
        for n in range(16, 16 + 64):
            head = data[n * SECTOR : (n + 1) * SECTOR]
            if len(head) < SECTOR or head[1:6] != b"CD001" or head[0] == 255:
                break
            joliet = head[0] == 2 and head[88:91] in (b"%/@", b"%/C", b"%/E")
            if head[0] == 1 or joliet:
                root, self.coding = head[156:190], "utf-16-be" if joliet else "latin-1"
        if root is None:
            raise Broken("no disc image")
        self.entries = self._walk(*struct.unpack_from("<I4xI", root, 2))

    def _walk(self, first: int, size: int) -> list[Entry]:
        out, todo, seen = [], [("", first, size)], set()
        while todo:
            folder, at, size = todo.pop()
            if at in seen:  # a folder inside itself
                continue
            seen.add(at)
            pieces = []
            for record in self._records(at, size):
                where, length = struct.unpack_from("<I4xI", record, 2)
                flags, wide = record[25], record[32]
                raw = record[33 : 33 + wide]
                if raw in (b"\0", b"\1"):
                    continue
                name = folder + raw.decode(self.coding, "replace").split(";")[0].rstrip(".")
                if flags & 2:
                    out.append(Entry(name + "/", 0, True, ()))
                    todo.append((name + "/", where, length))
                    continue
                pieces.append((where * SECTOR, length))
                if not flags & 0x80:  # the last of a file's pieces
                    out.append(Entry(name, sum(n for _, n in pieces), False, tuple(pieces)))
                    pieces = []
                if len(out) >= MOST_LISTED:
                    return out
        return out

    def _records(self, at: int, size: int) -> Iterator[bytes]:
        end = min(len(self.data), at * SECTOR + size)
        at *= SECTOR
        while at < end:
            length = self.data[at]
            if length < 34 or at + length > end:  # records don't cross sectors
                at = (at // SECTOR + 1) * SECTOR
                continue
            yield self.data[at : at + length]
            at += length

    def read(self, e: Entry) -> bytes:
        found = b"".join(self.data[a : a + n] for a, n in e.at)
        if len(found) < e.size:
            raise Broken(f"{e.name} ends early")
        return found


class Cabinet:
    """A cabinet; folders without compression and with MSZIP are unpacked, once each."""

    def __init__(self, data: bytes):
        if data[:4] != b"MSCF" or len(data) < 36:
            raise Broken("no cabinet")
        self.data, self.unpacked = data, {}
        (files,) = struct.unpack_from("<I", data, 16)
        folders, count, flags = struct.unpack_from("<HHH", data, 26)
        at, spare, self.spare = 36, 0, 0
        if flags & 4:
            head, spare, self.spare = struct.unpack_from("<HBB", data, at)
            at += 4 + head
        for _ in range(2 * bool(flags & 1) + 2 * bool(flags & 2)):  # names of the cabinets before and after
            at = data.index(b"\0", at) + 1
        self.folders = [struct.unpack_from("<IHH", data, at + i * (8 + spare)) for i in range(folders)]
        self.entries, at = [], files
        for _ in range(min(count, MOST_LISTED)):
            size, start, folder, attributes = struct.unpack_from("<IIH4xH", data, at)
            end = data.index(b"\0", at + 16)
            name = data[at + 16 : end].decode("utf-8" if attributes & 0x80 else "latin-1", "replace").replace("\\", "/")
            self.entries.append(Entry(name, size, False, (folder, start)))
            at = end + 1

    def _folder(self, n: int, most: int) -> bytes:
        if n not in self.unpacked:
            if n >= len(self.folders):
                raise Broken("a file's folder is in another cabinet")
            at, blocks, how = self.folders[n]
            if how & 15 not in (0, 1):
                raise Broken("a folder is packed in a way that isn't read")
            out, last, size = [], b"", 0
            for _ in range(blocks):
                packed, plain = struct.unpack_from("<HH", self.data, at + 4)
                raw = self.data[at + 8 + self.spare : at + 8 + self.spare + packed]
                at += 8 + self.spare + packed
                if how & 15:
                    if raw[:2] != b"CK":
                        raise Broken("a block isn't MSZIP")
                    raw = zlib.decompressobj(-15, zdict=last).decompress(raw[2:], plain or 1)
                last = (last + raw)[-32768:]
                size += len(raw)
                if size > most:
                    raise Broken("a folder unpacks beyond the budget")
                out.append(raw)
            self.unpacked[n] = b"".join(out)
        return self.unpacked[n]

    def read(self, e: Entry, most: int) -> bytes:
        folder, start = e.at
        found = self._folder(folder, most)[start : start + e.size]
        if len(found) < e.size:
            raise Broken(f"{e.name} ends early")
        return found


def opened(data: bytes) -> Image | Cabinet:
    """The image or cabinet in ``data``."""
    try:
        return Cabinet(data) if data[:4] == b"MSCF" else Image(data)
    except (struct.error, ValueError, IndexError) as e:
        raise Broken(f"{type(e).__name__}: {e}") from e


def members(data: bytes, most_files: int, most_bytes: int) -> Iterator[tuple[str, bytes]]:
    """(name, content) of files that can be read, within both limits."""
    box, left, count = opened(data), most_bytes, 0
    for e in box.entries:
        if e.is_dir or e.size > left or count >= most_files:
            continue
        try:
            got = box.read(e, most_bytes) if isinstance(box, Cabinet) else box.read(e)
        except (Broken, zlib.error, struct.error):
            continue
        left, count = left - len(got), count + 1
        yield e.name, got
