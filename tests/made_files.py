"""Makes inert PDF and compound files for tests, laid out in awkward ways."""

import random
import struct
import zlib


def pdf_text(x):
    """An object as PDF text: names are str, strings bytes, references ints in a tuple."""
    if isinstance(x, dict):
        return b"<<" + b"".join(k.encode("latin-1") + b" " + pdf_text(v) + b" " for k, v in x.items()) + b">>"
    if isinstance(x, list):
        return b"[" + b" ".join(map(pdf_text, x)) + b"]"
    if isinstance(x, tuple):
        return b"%d 0 R" % x
    if isinstance(x, bytes):
        return b"(" + x.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
    return str(x).encode("latin-1")


def make_pdf(objects, root=1, packed=False, table=True, junk=b"", streams=None, extra=None):
    """``objects`` by number; ``streams`` (entries, data) by number. ``packed`` puts objects into an object stream and the
    cross-reference into a stream with a PNG predictor; without ``table`` the cross-reference points nowhere."""
    out, places, streams = bytearray(junk + b"%PDF-1.7\n"), {}, dict(streams or {})
    base = len(junk)
    top = max([*objects, *streams])
    if packed:
        heads, body = [], b""
        for n, o in objects.items():
            heads.append(b"%d %d" % (n, len(body)))
            body += pdf_text(o) + b" "
        head = b" ".join(heads) + b" "
        holder = top + 1
        streams[holder] = ({"/Type": "/ObjStm", "/N": len(objects), "/First": len(head)}, head + body)
        for i, n in enumerate(objects):
            places[n] = (2, holder, i)
    else:
        for n, o in objects.items():
            places[n] = (1, len(out) - base, 0)
            out += b"%d 0 obj\n" % n + pdf_text(o) + b"\nendobj\n"
    for n, (entries, data) in streams.items():
        places[n] = (1, len(out) - base, 0)
        raw = zlib.compress(data)
        out += b"%d 0 obj\n" % n + pdf_text(entries | {"/Filter": "/FlateDecode", "/Length": len(raw)}) + b"\nstream\r\n" + raw + b"\nendstream\nendobj\n"
    at, size = len(out) - base, max(places) + 2
    trailer = {"/Size": size, "/Root": (root,)} | (extra or {})
    if packed:
        rows, above = b"", bytes(7)
        for n in range(size):
            kind, a, b = places.get(n, (0, 0, 0))
            if n == size - 1:
                kind, a, b = 1, at, 0
            row = struct.pack(">BIH", kind, a, b)
            rows += b"\2" + bytes((x - y) & 255 for x, y in zip(row, above))
            above = row
        raw = zlib.compress(rows)
        out += b"%d 0 obj\n" % (size - 1) + pdf_text(trailer | {"/Type": "/XRef", "/W": [1, 4, 2], "/Filter": "/FlateDecode", "/DecodeParms": {"/Predictor": 12, "/Columns": 7}, "/Length": len(raw)}) + b"\nstream\n" + raw + b"\nendstream\nendobj\n"
    else:
        out += b"xref\n0 %d\n" % size + b"0000000000 65535 f \n"
        for n in range(1, size):
            out += b"%010d 00000 n \n" % places[n][1] if n in places else b"0000000000 00000 f \n"
        out += b"trailer\n" + pdf_text(trailer) + b"\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % (at if table else 7))


def vba_packed(source):
    """A compressed container of literals alone."""
    out = bytearray(b"\1")
    for i in range(0, len(source), 3640):  # eight literals cost nine bytes, and a chunk holds 4096
        part = source[i : i + 3640]
        body = b"".join(b"\0" + part[j : j + 8] for j in range(0, len(part), 8))
        out += struct.pack("<H", 0xB000 | (len(body) - 1)) + body
    return bytes(out)


def vba_dir(modules, code_page=1252):
    """The unpacked ``dir`` stream of (name, stream, offset)."""
    rec = lambda kind, body: struct.pack("<HI", kind, len(body)) + body
    out = rec(1, struct.pack("<I", 1)) + rec(3, struct.pack("<H", code_page)) + rec(4, b"Project") + struct.pack("<HIIH", 9, 4, 1, 2)
    for name, stream, offset in modules:
        out += rec(0x19, name.encode()) + rec(0x1A, stream.encode()) + rec(0x31, struct.pack("<I", offset)) + rec(0x2B, b"")
    return out + rec(0x10, b"")


def make_ole(streams, seed=0, loop=False):
    """A compound file of {path: bytes} whose sectors are dealt at random; with ``loop``, the last chain runs into itself."""
    r = random.Random(seed)
    names, kids = [("Root Entry", 5, None)], {0: []}
    index = {"": 0}
    for path in streams:
        at = ""
        for part in path.split("/"):
            up, at = at, f"{at}/{part}" if at else part
            if at not in index:
                index[at] = len(names)
                names.append((part, 2 if at == path else 1, streams[path] if at == path else None))
                kids[index[at]] = []
                kids[index[up]].append(index[at])
    mini, mini_fat, big, starts = b"", [], [], {}
    for n, (_, kind, data) in enumerate(names):
        if kind == 2 and len(data) < 4096:
            count = -(-len(data) // 64)
            starts[n] = len(mini_fat) if count else 0xFFFFFFFE
            mini_fat += [len(mini_fat) + i + 1 for i in range(count - 1)] + [0xFFFFFFFE] * (count > 0)
            mini += data.ljust(count * 64, b"\0")
        elif kind == 2:
            big.append((n, data))
    entries = len(names) + (-len(names) % 4)
    parts = [("dir", bytes(entries * 128)), ("mini", mini), ("minifat", struct.pack(f"<{len(mini_fat)}I", *mini_fat)), *big]
    need = sum(-(-len(d) // 512) for _, d in parts)
    fats = 1
    while fats * 128 < need + fats:
        fats += 1
    order = list(range(need + fats))
    r.shuffle(order)
    table, sectors, first = [0xFFFFFFFF] * (fats * 128), {}, {}
    tables = [order.pop() for _ in range(fats)]
    for t in tables:
        table[t] = 0xFFFFFFFD
    for key, data in parts:
        own = [order.pop() for _ in range(-(-len(data) // 512))]
        first[key] = own[0] if own else 0xFFFFFFFE
        for i, s in enumerate(own):
            sectors[s] = data[i * 512 : i * 512 + 512].ljust(512, b"\xff" if key == "minifat" else b"\0")
            table[s] = own[i + 1] if i + 1 < len(own) else (own[0] if loop and key == parts[-1][0] else 0xFFFFFFFE)
        if key == "dir":
            dir_sectors = own
    raw = b""
    for n, (name, kind, data) in enumerate(names):
        below = kids[n]
        child = below[0] if below else 0xFFFFFFFF
        siblings = next((k for k in kids.values() if n in k), [])
        after = siblings[siblings.index(n) + 1] if n in siblings and siblings.index(n) + 1 < len(siblings) else 0xFFFFFFFF
        start = first["mini"] if n == 0 else starts.get(n, first.get(n, 0))
        wide = name.encode("utf-16-le") + b"\0\0"
        size = len(mini) if n == 0 else len(data or b"")
        raw += wide.ljust(64, b"\0") + struct.pack("<HBBIII", len(wide), kind, 1, 0xFFFFFFFF, after, child) + bytes(36) + struct.pack("<IQ", start, size)
    raw = raw.ljust(entries * 128, b"\0")
    for i, s in enumerate(dir_sectors):
        sectors[s] = raw[i * 512 : i * 512 + 512].ljust(512, b"\0")
    for i, t in enumerate(tables):
        sectors[t] = struct.pack("<128I", *table[i * 128 : i * 128 + 128])
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIII", 0, fats, first["dir"], 0, 4096)
    head += struct.pack("<IIII", first["minifat"], -(-len(mini_fat) // 128), 0xFFFFFFFE, 0) + struct.pack("<109I", *tables, *[0xFFFFFFFF] * (109 - fats))
    return head + b"".join(sectors[i] for i in range(len(sectors)))


def make_iso(files, joliet=False, loop=False):
    """An ISO 9660 image of {path: bytes}; the last file lies in two pieces; with ``loop`` the first folder holds the root."""
    coding = "utf-16-be" if joliet else "latin-1"
    folders = {""} | {"/".join(p.split("/")[:i]) for p in files for i in range(1, p.count("/") + 1)}
    spot, at = {}, 20
    for f in sorted(folders):
        spot[f], at = at, at + 2
    for p, data in files.items():
        spot[p], at = at, at + max(1, -(-len(data) // 2048)) + 1
    body = bytearray(at * 2048)

    def record(name, where, size, flags):
        raw = name if isinstance(name, bytes) else name.encode(coding)
        out = bytearray(33 + len(raw) + (len(raw) + 1) % 2)
        out[0] = len(out)
        struct.pack_into("<I", out, 2, where)
        struct.pack_into("<I", out, 10, size)
        out[25], out[32] = flags, len(raw)
        out[33 : 33 + len(raw)] = raw
        return bytes(out)

    for f in folders:
        inside = [record(b"\0", spot[f], 4096, 2), record(b"\1", spot[""], 4096, 2)]
        for name in sorted(folders | set(files)):
            if name and name.rpartition("/")[0] == f:
                leaf = name.rpartition("/")[2]
                if name in folders:
                    inside.append(record(leaf, spot[name], 4096, 2))
                elif name == list(files)[-1]:
                    inside += [record(leaf + ";1", spot[name], 2048, 0x80), record(leaf + ";1", spot[name] + 1, len(files[name]) - 2048, 0)]
                else:
                    inside.append(record(leaf + ";1", spot[name], len(files[name]), 0))
        if loop and f:
            inside.append(record("again", spot[""], 4096, 2))
        sector, used = bytearray(4096), 0
        for r in inside:
            used = used if used % 2048 + len(r) <= 2048 else 2048
            sector[used : used + len(r)] = r
            used += len(r)
        body[spot[f] * 2048 : spot[f] * 2048 + 4096] = sector
    for p, data in files.items():
        body[spot[p] * 2048 : spot[p] * 2048 + len(data)] = data
    for n, kind in enumerate([1, 2] if joliet else [1]):
        head = bytearray(2048)
        head[0], head[1:6] = kind, b"CD001"
        if kind == 2:
            head[88:91] = b"%/E"
        if kind == 2 or not joliet:
            head[156 : 156 + 34] = record(b"\0", spot[""], 4096, 2)
        body[(16 + n) * 2048 : (17 + n) * 2048] = head
    body[18 * 2048 : 18 * 2048 + 7] = b"\xffCD001\1"
    return bytes(body)


def make_cab(files, packed=True, spare=b""):
    """A cabinet of {name: bytes} in one folder, in blocks of 32 KiB that share a window."""
    plain, blocks, last = b"".join(files.values()), [], b""
    for i in range(0, len(plain), 32768):
        part = plain[i : i + 32768]
        if packed:
            z = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=last) if last else zlib.compressobj(9, zlib.DEFLATED, -15)
            raw = b"CK" + z.compress(part) + z.flush()
        else:
            raw = part
        last = (last + part)[-32768:]
        blocks.append(struct.pack("<IHH", 0, len(raw), len(part)) + spare + raw)
    head = 36 + (4 + len(spare) if spare else 0)
    rows, start = b"", 0
    for name, data in files.items():
        utf = not name.isascii()
        rows += struct.pack("<IIHHHH", len(data), start, 0, 0, 0, 0x80 if utf else 0x20) + name.encode() + b"\0"
        start += len(data)
    first = head + 8 + len(spare)
    out = b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, 0, 0, first, 0, 3, 1, 1, len(files), 4 if spare else 0, 1, 0)
    out += struct.pack("<HBB", len(spare), len(spare), len(spare)) + spare if spare else b""
    return out + struct.pack("<IHH", first + len(rows), len(blocks), int(packed)) + spare + rows + b"".join(blocks)
