"""Removal of repeated passages by prefix-free parsing.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller id goes. Texts are bytes of
UTF-8, and no string crosses documents.

*Parse.* A rolling hash runs over all ``GRAM``-byte windows. The least hash among the windows of a string is its trigger, so
each string of ``LENGTH`` bytes has exactly one, at one place, wherever it occurs, and phrases end at least every
``LENGTH - GRAM + 1`` bytes (triggers by a modulus would leave strings without any). The strings that share a trigger start at
neighbouring bytes; together they are a *block*, the end of one phrase and what follows its trigger.

*Dictionary.* Equal blocks are one entry with the smallest id that holds it, so copies cost one entry for each chunk of
documents. Where a block's entry has a smaller id, all its strings go, unread. Only entries whose trigger also stands in
other blocks, of other documents, are looked at further, once each.

*Suffix arrays.* All strings of such an entry are a suffix of its phrase, of l bytes before the trigger, and a prefix of
the parse after it, of LENGTH - l bytes. Entries are sorted twice, by what precedes the trigger, read backwards, and by what
follows it, each with the common lengths of neighbours. Two entries share their string at l just if no neighbour between
them has less than l in common in one array and less than LENGTH - l in the other; the pair of ranks is the string's
class in corpus order. The least id of a class removes the string from all others.

Work is dealt by chunks of about ``CHUNK`` bytes of documents and by ranges of trigger hashes; both counts grow with the input. A trigger
of more than ``HOT`` blocks isn't one task's: its strings are dealt by their own hashes, of 128 bits. Blocks are equal if trigger and
block agree in 128 bits of hashes; entries in the arrays are compared byte by byte. All steps are one plan, in which texts
are exchanged once; nothing but the total of bytes reaches the driver.

Null text is empty; texts under ``LENGTH`` bytes stay whole. A null id is neither smaller nor greater than any: such rows keep
all and cost others nothing. Rows of one id don't remove each other's bytes, repeated rows get equal results, and very
long texts are parsed in slices. An empty table gives no rows. Other columns ride along, whatever their names; columns
named as the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, table

LENGTH, GRAM = 50, 20
#: Bytes of documents in a chunk, of all documents for each range of triggers, and starts that are parsed at once.
CHUNK, RANGE, SLICE = 4 << 20, 24 << 20, 1 << 20
#: Blocks of one trigger beyond which its strings are dealt one by one.
HOT = 20_000
NEW = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "spans": "array<long>", "kept": "binary"}
U = np.uint64
_BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))


def _mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> U(31))) * by
    return x ^ (x >> U(29))


@lru_cache(2)
def _tables(size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For both hashes: a number for each byte, the powers of the base and of its inverse."""
    out = []
    for base in _BASES:
        codes = _mix(np.arange(1, 257, dtype=U) * base, _MIX[0])
        back = U(pow(int(base), -1, 1 << 64))
        powers, inverse = np.full(size, base, U), np.full(size, back, U)
        powers[0] = inverse[0] = 1
        out.append((codes, np.cumprod(powers), np.cumprod(inverse)))
    return out


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    codes, powers, _ = _tables(SLICE + 4096)[which]
    out = np.zeros(len(data) + 1, U)
    np.cumsum(codes[data] * powers[: len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    return (sums[end] - sums[start]) * _tables(SLICE + 4096)[which][2][start]


class Parse:
    """The blocks of one slice: ``start`` and ``end`` of their strings' starts, ``at`` of the trigger, and two hashes."""

    def __init__(self, data: np.ndarray, valid: np.ndarray, length: int):
        reach = length - GRAM + 1
        n = len(data) - length + 1
        sums = _sums(data, 0)
        gram = (sums[GRAM:] - sums[:-GRAM]) * _tables(SLICE + 4096)[0][2][: len(data) - GRAM + 1]
        least = (_mix(gram, _MIX[0]) & ~U((1 << 24) - 1)) | np.arange(len(gram), dtype=U)
        width = 1
        while 2 * width <= reach:  # least of 2, 4, 8, ... windows
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if reach > width:
            least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        owner = (least[:n] & U((1 << 24) - 1)).astype(np.int64)
        owner[~valid[:n]] = -1
        edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        end = np.r_[edge[1:], n]
        own = owner[edge] >= 0
        self.start, self.end = edge[own], end[own]
        self.at = owner[self.start]
        self.trigger = _mix(gram[self.at] ^ _MIX[1], _MIX[1])
        whole = _hash(_sums(data, 1), self.start, self.end + (length - 1), 1)
        self.block = _mix(whole ^ ((self.at - self.start).astype(U) << U(56)), _MIX[0])


class Chunk:
    """Documents of a chunk in a fixed order, their blocks, and the chunk's entries: distinct blocks by (trigger, block)."""

    def __init__(self, found: pa.Table, length: int, ranges: int):
        self.order = np.lexsort((found["_t"].to_numpy(), found["_d"].fill_null(0).to_numpy(), found["_d"].is_null().to_numpy()))
        ids = found["_d"].take(self.order)
        texts = found["_text"].take(self.order).fill_null(b"").to_pylist()
        self.texts, self.ids, self.length = texts, ids, length
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        named = ~ids.is_null().to_numpy()
        valid = np.zeros(max(len(self.data), 1), np.int8)
        for last, size in zip(self.ends[named], self.sizes[named]):
            if size >= length:
                valid[last - size : last - length + 1] = 1
        valid = valid.astype(bool)
        parts = []
        for lo in range(0, max(0, len(self.data) - length + 1), SLICE):
            if valid[lo : lo + SLICE].any():
                p = Parse(self.data[lo : lo + SLICE + length - 1], valid[lo : lo + SLICE], length)
                parts.append((p.start + lo, p.end + lo, p.at + lo, p.trigger, p.block))
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
        self.start, self.end, self.at, trigger, block = map(np.concatenate, zip(*parts)) if parts else none
        self.doc = ids.fill_null(0).to_numpy()[np.searchsorted(self.ends, self.start, "right")]
        order = np.lexsort((self.doc, block, trigger))
        t, b = trigger[order], block[order]
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | (b[1:] != b[:-1])
        self.entry = np.empty(len(t), np.int64)  # of each block
        self.entry[order] = np.cumsum(first) - 1
        self.leader = order[first]  # the entry's block in the document with the least id
        self.trigger, self.block = t[first], b[first]
        self.least = self.doc[self.leader]
        self.range = _range_of(self.trigger, ranges)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (((keys >> U(32)) * U(ranges)) >> U(32)).astype(np.int32)


def _groups(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of the runs of a sorted array."""
    if len(x):
        edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        yield from zip(x[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(x)])


def _packed(ids: np.ndarray) -> bytes:
    """Ids as their least and four bytes each, or eight where that is too little."""
    base = int(ids.min())
    small = int(ids.max()) - base < 1 << 32
    return np.array([base, small], np.int64).tobytes() + (ids - base).astype(np.uint32 if small else np.int64).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    base, small = np.frombuffer(data, np.int64, 2).tolist()
    return np.frombuffer(data, np.uint32 if small else np.int64, n, 16).astype(np.int64) + base


def entries(chunk: Chunk, number: int) -> pa.Table:
    """The chunk's entries by ranges of triggers: (range, chunk, triggers and blocks, least ids)."""
    rows = [(k, number, chunk.trigger[a:b].tobytes(), chunk.block[a:b].tobytes(), _packed(chunk.least[a:b])) for k, a, b in _groups(chunk.range)]
    return pa.table(dict(zip(("range", "chunk", "t", "b", "d"), zip(*rows) if rows else ((),) * 5)), ENTRIES)


ENTRIES = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("t", pa.binary()), ("b", pa.binary()), ("d", pa.binary())])
ANSWERS = pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("at", pa.binary()), ("least", pa.binary()), ("lead", pa.binary()), ("hot", pa.binary()), ("masks", pa.binary())])
SOUGHT = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("entry", pa.binary()), ("d", pa.binary()), ("key", pa.binary()), ("shape", pa.binary()), ("bytes", pa.binary())])


def compared(found: pa.Table) -> pa.Table:
    """For one range of triggers: to each chunk, the entries that a smaller id has elsewhere, and those to look at further."""
    counts = np.array([len(x) // 8 for x in found["t"].to_pylist()])
    t, b = (np.frombuffer(b"".join(found[c].to_pylist()), U) for c in ("t", "b"))
    d = np.concatenate([_unpacked(x, n) for x, n in zip(found["d"].to_pylist(), counts)])
    order = np.lexsort((b, t))
    ts, bs = t[order], b[order]
    new_t = np.r_[True, ts[1:] != ts[:-1]]
    new_b = new_t | np.r_[True, bs[1:] != bs[:-1]]
    edge_t, edge_b = np.flatnonzero(new_t), np.flatnonzero(new_b)
    least = np.minimum.reduceat(d[order], edge_b)
    blocks = np.add.reduceat(new_b.astype(np.int64), edge_t)
    apart = np.minimum.reduceat(d[order], edge_t) < np.maximum.reduceat(d[order], edge_t)
    of_t = np.cumsum(new_t) - 1
    best, seek, hot = np.empty_like(d), np.empty(len(d), bool), np.empty(len(d), bool)
    best[order] = least[np.cumsum(new_b) - 1]
    seek[order] = (apart & (blocks > 1))[of_t]
    hot[order] = (blocks > HOT)[of_t]
    seek &= best == d
    rows, at = [], 0
    for number, k, n in zip(found["chunk"].to_pylist(), found["range"].to_pylist(), counts):
        own = slice(at, at + n)
        at += n
        late = np.flatnonzero(best[own] < d[own]).astype(np.uint32)
        lead, far = (np.flatnonzero(seek[own] & x).astype(np.uint32) for x in (~hot[own], hot[own]))
        if len(late) or len(lead) or len(far):
            rows.append((number, k, late.tobytes(), best[own][late].tobytes(), lead.tobytes(), far.tobytes(), b""))
    return pa.table(dict(zip(ANSWERS.names, zip(*rows) if rows else ((),) * 7)), ANSWERS)


def _asked(chunk: Chunk, answers: pa.Table, what: str) -> np.ndarray:
    begin = {k: a for k, a, _ in _groups(chunk.range)}
    parts = [np.frombuffer(x, np.uint32).astype(np.int64) + begin[k] for k, x in zip(answers["range"].to_pylist(), answers[what].to_pylist()) if x]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def sought(chunk: Chunk, answers: pa.Table, number: int, ranges: int) -> pa.Table:
    """What the arrays need of the entries asked for: their bytes; of hot triggers, the hash of each string."""
    rows, length = [], chunk.length
    zip_up = zstandard.ZstdCompressor(level=3)
    lead = np.sort(_asked(chunk, answers, "lead"))
    for k, a, b in _groups(chunk.range[lead]):
        e = lead[a:b]
        own = chunk.leader[e]
        s, end = chunk.start[own], chunk.end[own]
        raw = b"".join(chunk.data[i:j].tobytes() for i, j in zip(s.tolist(), (end + length - 1).tolist()))
        shape = np.stack([chunk.at[own] - s, end - s]).astype(np.uint16)
        rows.append((k, number, e.astype(np.uint32).tobytes(), _packed(chunk.least[e]), chunk.trigger[e].tobytes(), shape.tobytes(), zip_up.compress(raw)))
    hot = _asked(chunk, answers, "hot")
    if len(hot):
        own = chunk.leader[hot]
        many = chunk.end[own] - chunk.start[own]
        e, at = np.repeat(hot, many), np.repeat(chunk.at[own], many)
        s = np.repeat(chunk.start[own] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        h = np.zeros((2, len(s)), U)
        for j in range(length):
            byte = chunk.data[s + j].astype(U) + U(1)
            for i in (0, 1):
                h[i] = (h[i] + byte) * _BASES[i]
        h = np.stack([_mix(x, _MIX[0]) for x in h])
        order = np.argsort(h[0])
        e, h, back = e[order], h[:, order], (at - s)[order].astype(np.uint16)
        for k, a, b in _groups(_range_of(h[0], ranges)):
            rows.append((k, number, e[a:b].astype(np.uint32).tobytes(), _packed(chunk.least[e[a:b]]), h[:, a:b].tobytes(), back[a:b].tobytes(), None))
    return pa.table(dict(zip(SOUGHT.names, zip(*rows) if rows else ((),) * 7)), SOUGHT)


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """Columns of a byte matrix as big-endian numbers, the last first, as lexsort wants them."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return list(wide.view(">u8").astype(U).T[::-1])


def _array(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array of the rows inside groups, and the bytes that each has in common with the one before; -1 across groups."""
    order = np.lexsort([*_words(rows), group])
    sorted_rows, g = rows[order], group[order]
    same = np.full(len(rows), -1, np.int64)
    differ = sorted_rows[1:] != sorted_rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    same[1:] = np.where(g[1:] == g[:-1], common, -1)
    return order, same


def shared_strings(trigger: np.ndarray, d: np.ndarray, before: np.ndarray, many: np.ndarray, raw: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For entries (``before`` bytes before the trigger, ``many`` starts, bytes one after the other): a bit l for each string,
    l bytes before the trigger, that an entry of the same trigger with a smaller id has too."""
    n, reach = len(d), length - GRAM + 1
    sizes = many + length - 1
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    padded = np.r_[raw, np.zeros(length + reach, np.uint8)]
    column = np.arange(length)
    trig = begin + before
    after = np.where(column < (begin + sizes - trig)[:, None], padded[trig[:, None] + column], 0).astype(np.uint8)
    column = np.arange(reach - 1)
    prior = np.where(column < before[:, None], padded[np.maximum(trig[:, None] - 1 - column, 0)], 0).astype(np.uint8)
    parse, in_parse = _array(trigger, after)
    phrases, in_phrases = _array(trigger, prior)

    def most(order: np.ndarray, common: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.maximum(common, np.r_[common[1:], -1])
        return out

    near_parse, near_phrases = most(parse, in_parse), most(phrases, in_phrases)
    masks = np.zeros(n, np.uint64)
    rank_parse, rank_phrases = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(reach):
        own = np.flatnonzero((l <= before) & (l > before - many) & (near_phrases >= l) & (near_parse >= length - l))
        if len(own) < 2:
            continue
        rank_parse[parse] = np.cumsum(in_parse < length - l)
        rank_phrases[phrases] = np.cumsum(in_phrases < l)
        place = rank_phrases[own] * (n + 1) + rank_parse[own]
        masks[own] |= _later(place, d[own]).astype(U) << U(l)
    return masks


def _later(place: np.ndarray, d: np.ndarray) -> np.ndarray:
    """True where a smaller id has the same place."""
    order = np.argsort(place)
    p = place[order]
    first = np.r_[True, p[1:] != p[:-1]]
    least = np.minimum.reduceat(d[order], np.flatnonzero(first))
    out = np.empty(len(d), bool)
    out[order] = d[order] > least[np.cumsum(first) - 1]
    return out


def resolved(found: pa.Table, length: int) -> pa.Table:
    """Answers with the masks of the strings that smaller ids have too, for the entries sought in one range."""
    rows = []
    plain = np.array([x is not None for x in found["bytes"].to_pylist()])
    for kind in (True, False):
        part = found.filter(pa.array(plain == kind))
        if not part.num_rows:
            continue
        counts = [len(x) // 4 for x in part["entry"].to_pylist()]
        e = [np.frombuffer(x, np.uint32) for x in part["entry"].to_pylist()]
        d = np.concatenate([_unpacked(x, n) for x, n in zip(part["d"].to_pylist(), counts)])
        if kind:
            unzip = zstandard.ZstdDecompressor()
            shape = np.concatenate([np.frombuffer(x, np.uint16).reshape(2, -1) for x in part["shape"].to_pylist()], 1).astype(np.int64)
            raw = np.frombuffer(b"".join(unzip.decompress(x) for x in part["bytes"].to_pylist()), np.uint8)
            masks = shared_strings(np.frombuffer(b"".join(part["key"].to_pylist()), U), d, *shape, raw, length)
        else:
            h = np.concatenate([np.frombuffer(x, U).reshape(2, -1) for x in part["key"].to_pylist()], 1)
            order = np.lexsort(h)
            s = h[:, order]
            place = np.empty(len(d), np.int64)
            place[order] = np.cumsum(np.r_[True, (s[:, 1:] != s[:, :-1]).any(0)])
            back = np.concatenate([np.frombuffer(x, np.uint16) for x in part["shape"].to_pylist()]).astype(U)
            masks = _later(place, d).astype(U) << back
        at = 0
        for number, k, mine in zip(part["chunk"].to_pylist(), part["range"].to_pylist(), e):
            bits = masks[at : at + len(mine)]
            at += len(mine)
            if bits.any():
                rows.append((number, k, mine[bits > 0].tobytes(), None, None, None, bits[bits > 0].tobytes()))
    return pa.table(dict(zip(ANSWERS.names, zip(*rows) if rows else ((),) * 7)), ANSWERS)


def removed(chunk: Chunk, answers: pa.Table) -> np.ndarray:
    """True for each byte of the chunk that goes."""
    least, masks = chunk.least.copy(), np.zeros(len(chunk.least), U)
    begin = {k: a for k, a, _ in _groups(chunk.range)}
    for k, at, low, bits in zip(*[answers[c].to_pylist() for c in ("range", "at", "least", "masks")]):
        e = np.frombuffer(at, np.uint32).astype(np.int64)
        if bits:
            np.bitwise_or.at(masks, e, np.frombuffer(bits, U))
        elif len(e):
            least[e + begin[k]] = np.frombuffer(low, np.int64)
    turns = np.zeros(len(chunk.data) + 1, np.int64)
    over = np.flatnonzero(least[chunk.entry] < chunk.doc)
    np.add.at(turns, chunk.start[over], 1)
    np.add.at(turns, chunk.end[over] + (chunk.length - 1), -1)
    rest = np.flatnonzero((least[chunk.entry] >= chunk.doc) & (masks[chunk.entry] > 0))
    bits = masks[chunk.entry[rest]]
    for l in range(chunk.length - GRAM + 1):
        s = chunk.at[rest[(bits >> U(l)) & U(1) > 0]] - l
        np.add.at(turns, s, 1)
        np.add.at(turns, s + chunk.length, -1)
    return np.cumsum(turns[:-1]) > 0


def results(chunk: Chunk, answers: pa.Table, found: pa.Table) -> pa.Table:
    gone = removed(chunk, answers)
    rows = []
    for text, end, size in zip(chunk.texts, chunk.ends.tolist(), chunk.sizes.tolist()):
        own = gone[end - size : end]
        if not own.any():
            rows.append((size, 0, 0, [], text))
            continue
        turn = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
        rows.append((size, int(own.sum()), len(turn) // 2, turn.tolist(), chunk.data[end - size : end][~own].tobytes()))
    made = dict(zip(NEW, zip(*rows)))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
    return pa.table({"_row": found["_row"].take(chunk.order), **{k: pa.array(v, t) for (k, v), t in zip(made.items(), types)}})


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, chunk_bytes: int = CHUNK, range_bytes: int = RANGE) -> DataFrame:
    """``df`` without ``text``, plus ``kept`` (the bytes that stay), their counts, and ``spans``: start and end of each run that goes."""
    if not GRAM < length <= GRAM + 63:
        raise ValueError(f"length must be {GRAM + 1} to {GRAM + 63}")
    body = F.col(f"`{text}`")
    total = df.agg(F.sum(F.octet_length(body))).first()[0] or 0
    chunks, ranges = total // chunk_bytes + 1, total // range_bytes + 1
    own = F.struct(*[named(c).alias(c) for c in df.columns if c != text and c.lower() not in NEW])
    digest = F.xxhash64(body)
    doc = F.col(f"`{key}`").cast("long")
    x = df.select(F.pmod(F.xxhash64(doc, digest), F.lit(chunks)).alias("_chunk"), doc.alias("_d"), digest.alias("_t"), body.cast("binary").alias("_text"), own.alias("_row")).groupBy("_chunk")
    ddl = lambda s: ", ".join(f"{f.name} {({pa.int32(): 'int', pa.int64(): 'long'}).get(f.type, 'binary')}" for f in s)

    def make(found: pa.Table) -> pa.Table:
        return entries(Chunk(found, length, ranges), found["_chunk"][0].as_py())

    def ask(found: pa.Table, answers: pa.Table) -> pa.Table:
        if not found.num_rows or not any(map(any, (answers["lead"].to_pylist(), answers["hot"].to_pylist()))):
            return SOUGHT.empty_table()
        return sought(Chunk(found, length, ranges), answers, found["_chunk"][0].as_py(), ranges)

    def finish(found: pa.Table, answers: pa.Table) -> pa.Table:
        return results(Chunk(found, length, ranges), answers, found)

    first = x.applyInArrow(make, ddl(ENTRIES)).groupBy("range").applyInArrow(compared, ddl(ANSWERS))
    inner = x.cogroup(first.groupBy("chunk")).applyInArrow(ask, ddl(SOUGHT))
    second = inner.groupBy("range").applyInArrow(lambda found: resolved(found, length), ddl(ANSWERS))
    schema = T.StructType([T.StructField("_row", df.select(own.alias("_row")).schema["_row"].dataType), *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in NEW.items()))])
    return x.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(finish, schema).select("_row.*", *NEW)


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_suffix_array_dedup": op12_suffix_array_dedup}
#: Whole texts byte by byte against all others aren't work for SQL; the query is tested against a brute-force version.
SQL: dict[str, str] = {}
