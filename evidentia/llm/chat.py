"""Chat formatting with offset-aligned loss masks.

A conversation is rendered once, as a whole; what each turn's text covers in the rendered string is known while it is
written. The string is encoded once, with offsets, and the sorted text spans of the assistant's turns are intersected
with the sorted token spans by binary search: a token bears loss when it overlaps such a span.

Template: ``<s>`` opens a conversation; a turn is ``[ROLE]``, a space, its text, and ``[/ROLE]``, where the assistant's
turn ends in ``</s>``; control strings inside texts and roles are escaped by a zero-width ``ESCAPE`` character after their
first character, and the escape character itself is doubled, so that the rendered string reads back to the same turns.

Rows are ordered by turn, then role and text, so ties have one order. Null texts are empty; null roles are the role
``""``. A null conv_id is a conversation of its own. Repeated rows are turns like others; an empty table gives no rows. A
conversation is one unit of work and memory, as it is one string; rows are dealt by its id, sorted where they then lie, and
read as a stream. The query's own conversation -1 would take in the rows of one with that id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
ESCAPE = "⁠"
OPEN, CLOSE = "<s>", "</s>"
#: Any of these, in a text, could be read as the template's own.
CONTROL = re.compile(r"(<(?=/?s>)|\[(?=/?(?:INST|SYS|TURN)\b)|⁠)")
NAMES = {"user": "INST", "system": "SYS"}
#: Characters of formatted text after which a batch of conversations is handed on.
BATCH_CHARS = 2_000_000


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + ESCAPE, text)


def unescape(text: str) -> str:
    return re.sub(r"([<\[⁠])⁠", r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string of (role, text) turns, and the span of each assistant text, end mark excluded."""
    parts, spans, at = [OPEN], [], len(OPEN)
    for role, text in turns:
        body = escape(text)
        if role == "assistant":
            head, tail = " ", CLOSE
        elif role in NAMES:
            head, tail = f"[{NAMES[role]}] ", f" [/{NAMES[role]}]"
        else:  # the role itself, with its length, so that any role reads back
            name = escape(role)
            head, tail = f"[TURN {len(name)}] {name} ", " [/TURN]"
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, tail)
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


_TURN = re.compile(r"\[(INST|SYS)\] (.*?) \[/\1\]|\[TURN (\d+)\] |( )(.*?)</s>", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered string."""
    if not formatted.startswith(OPEN):
        raise ValueError("not a rendered conversation")
    at, turns = len(OPEN), []
    roles = {v: k for k, v in NAMES.items()}
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        if m[1]:
            turns.append((roles[m[1]], unescape(m[2])))
            at = m.end()
        elif m[3]:
            role = formatted[m.end() : m.end() + int(m[3])]
            start = m.end() + int(m[3]) + 1
            end = formatted.index(" [/TURN]", start)
            turns.append((unescape(role), unescape(formatted[start:end])))
            at = end + len(" [/TURN]")
        else:
            turns.append(("assistant", unescape(m[5])))
            at = m.end()
    return turns


def _ends(pairs) -> tuple[np.ndarray, np.ndarray]:
    both = np.asarray(pairs, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _tokens_of(starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> slice:
    """The tokens that overlap a span, first and last found by bisection."""
    return slice(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))) if b > a else slice(0, 0)


def mask_tokens(offsets, spans) -> np.ndarray:
    """True for tokens that overlap a span. Both are sorted (start, end) pairs."""
    starts, ends = _ends(offsets)
    out = np.zeros(len(starts), bool)
    for a, b in spans:
        out[_tokens_of(starts, ends, a, b)] = True
    return out


def masked_text(formatted: str, spans, offsets, mask) -> str:
    """The text under the mask, unescaped: of each masked token the part inside the spans, each character once."""
    starts, ends = _ends(offsets)
    out = []
    for a, b in spans:
        at = _tokens_of(starts, ends, a, b)
        on = np.asarray(mask[at], bool)
        low, high = np.maximum(starts[at][on], a), np.minimum(ends[at][on], b)
        if len(low):  # the bytes of one character may be several tokens with one offset
            low[1:] = np.maximum(low[1:], np.maximum.accumulate(high)[:-1])
        low, high = low[high > low], high[high > low]
        breaks = np.flatnonzero(low[1:] != high[:-1])  # neighbouring tokens are cut out as one run
        runs = zip(low[np.append(0, breaks + 1)].tolist(), high[np.append(breaks, len(high) - 1)].tolist()) if len(low) else ()
        out.append(unescape("".join(formatted[x:y] for x, y in runs)))
    return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """(conv_id, turns) of rows that come sorted by conversation and turn."""
    at, turns = None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if turns and conv != at:
                yield at, turns
                turns = []
            at = conv
            turns.append((role or "", text or ""))
    if turns:
        yield at, turns


def _nested(rows: list[np.ndarray], width: int) -> pa.ListArray:
    """A list column of flat arrays; of pairs where ``width`` is 2."""
    ends = np.cumsum([0] + [len(r) // width for r in rows]).astype(np.int32)
    flat = pa.array(np.concatenate(rows))
    if width > 1:
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), flat)
    return pa.ListArray.from_arrays(pa.array(ends), flat)


FORMATTED = "conv_id long, formatted string, spans array<array<int>>, token_ids array<int>, offsets array<array<int>>, loss_mask array<boolean>"
NAMES_OUT = ["conv_id", "formatted", "spans", "token_ids", "offsets", "loss_mask"]


def _format(path: str):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        conv, text, spans, ids, offsets, mask = zip(*rows)
        columns = [pa.array(conv, pa.int64()), pa.array(text, pa.string()), _nested(spans, 2), _nested(ids, 1), _nested(offsets, 2), _nested(mask, 1)]
        return pa.RecordBatch.from_arrays(columns, NAMES_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for conv, turns in _conversations(batches):
            formatted, spans = render(turns)
            e = load(path).encode(formatted, add_special_tokens=False)
            offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
            rows.append((conv, formatted, np.array(spans, np.int32).ravel(), np.array(e.ids, np.int32), offsets.ravel(), mask_tokens(offsets, spans)))
            chars += len(formatted)
            if chars > BATCH_CHARS:
                yield batch(rows)
                rows, chars = [], 0
        if rows:
            yield batch(rows)

    return run


def format_chats(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each conversation of ``turns`` (conv_id, turn, role, text): its string, tokens and loss mask."""
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as few bytes would be few tasks for much work
    return rows.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format(tokenizer), FORMATTED)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        conv, formatted, spans, _, offsets, mask = batch.columns
        for k in range(len(batch)):
            text = formatted[k].as_py()
            turns = parse(text)
            loss = masked_text(text, spans[k].as_py(), np.asarray(offsets[k].values.flatten()), np.asarray(mask[k].values))
            out.append((conv[k].as_py(), len(turns), _sha("".join(f"{role}\n{said}\n" for role, said in turns)), len(loss), _sha(loss), len(text)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), DIGEST_TYPES)], DIGEST_NAMES) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in DIGEST_TYPES], DIGEST_NAMES)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGEST_NAMES = [c.split()[0] for c in DIGEST.split(", ")]
DIGEST_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user'), (-1L, 1L, 'assistant') AS t(conv_id, turn, role)").withColumn("text", F.lit(said))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return format_chats(turns).mapInArrow(_digest, DIGEST)


QUERIES = {"op10_chat_format": op10_chat_format}
#: Escapes and tokens have no SQL here; the tests read everything back instead.
SQL: dict[str, str] = {}
