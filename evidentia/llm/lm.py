"""Language-model scoring: base counts over every training document, and a gated recurrent model over them.

Counts. Every training token is counted: per task in a dictionary that is emptied when full, then by a shuffle on the
word. ``TOP`` frequent words at most (those above a count that a histogram of counts gives) go to the workers; any other
token of any text is sent, as (word, times), to a join with the whole table of counts. So no vocabulary is cut.

Model. The ``SYMBOLS`` most frequent words at most are symbols of the recurrent model (:mod:`.gru`). Every other word,
seen or not, is one of ``2 * SHAPES`` shapes, by its last bytes and whether punctuation follows, and its probability is that of the
shape times (count + 1) / (sum over the shape's words of (count + 1), plus 1 for words never seen). Hence the scores are of
the whole text over the whole vocabulary, comparable with the base.

Fitting. A bounded warm start on the driver (pieces drawn by seeded hashes from about ``WARM_DOCS`` training documents, at most
``WARM_PIECES`` of them and ``WARM_TOKENS`` tokens) is followed by a pass over every token of the corpus. Documents become pieces of ``PIECE``
symbols. A piece also takes along the ``LEAD`` symbols before it: they bring the state to where it begins and aren't learned again, so
only a document's first word is learned as one. Pieces are dealt by seeded hashes into buckets of about ``BUCKET_TOKENS`` (more once there are ``BUCKETS`` of them). Each bucket
learns from the same start, piece by piece in the order of their hashes and never held whole, and the weights are averaged
by tokens. So what is learned depends on the corpus, not on how it is partitioned.

Null text: no words, the end alone. Each row is scored on its own, repeated rows too. Without training rows every word
is unseen and scores are finite. Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, table
from .gru import WINDOW, Adam, Gru

END = b"\n"  # no word holds one
TOP, SYMBOLS, SHAPES = 150_000, 500, 64
WARM_DOCS, WARM_PIECES, WARM_TOKENS, WARM_EPOCHS, WARM_RATE = 300, 1_000, 150_000, 3, 6e-3
PASS_RATE, SEED = 6e-3, 23
LEAD, PIECE, BUCKET_TOKENS, BUCKETS, CHUNK_TOKENS, LANES = 40, 500, 1_000_000, 4_096, 500_000, 256
FOLDS, HELD_OUT = 7, 2
SLICE_ROWS, SCORE_TOKENS = 1_000, 2_000_000
LOG10 = math.log(10)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a batch of texts, one behind the other, and the text that each belongs to."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # \x20 and \x09-\x0D; A-Z alone
    words = lists.flatten()
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves empty words
    return words.filter(some).cast(pa.binary()), of[some.to_numpy(zero_copy_only=False)]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``SLICE_ROWS``, as words take several times the memory of their texts."""
    for b in batches:
        for k in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(k, SLICE_ROWS)


def shape(word: bytes) -> int:
    bare = word.rstrip(b".,;:!?\"')")
    return 2 * (zlib.crc32(bare[-3:]) % SHAPES) + (len(bare) != len(word))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        found = pc.value_counts(split(b.column(0))[0])
        words = pa.concat_arrays([found.field("values"), pa.array([END], pa.binary())])
        yield pa.RecordBatch.from_arrays([words, pa.concat_arrays([found.field("counts"), pa.array([b.num_rows], pa.int64())])], ["word", "n"])


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(2 * SHAPES, np.int64)
    for b in batches:
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[shape(w)] += n + 1
    yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], ["shape", "mass"])


class Lexicon:
    """Frequent words on a worker: their counts and symbols; the masses of shapes."""

    def __init__(self, words: list[bytes], counts: np.ndarray, masses: np.ndarray, total: int, types: int):
        self.words, self.counts, self.masses, self.total, self.types = words, counts, masses, total, types
        n = min(SYMBOLS, len(words))  # words come by falling count
        self.first = n
        self.end = words.index(END) if END in words[:n] else n
        self.size = n + (self.end == n) + 2 * SHAPES

    def freq(self) -> np.ndarray:
        f = np.ones(self.size)
        f[: self.first] = self.counts[: self.first]
        f[-2 * SHAPES :] = self.masses
        return f

    def ready(self) -> "Lexicon":
        """With what is made of the above on each worker."""
        base = self.size - 2 * SHAPES
        self.index = pa.array(self.words, pa.binary())
        self.at_end = self.words.index(END) if END in self.words else -1
        self.symbol = np.arange(len(self.words) + 1)
        self.symbol[self.first : -1] = [base + shape(w) for w in self.words[self.first :]]
        self.log1 = np.concatenate((np.log10(self.counts + 1.0), [0.0]))
        self.norm = np.concatenate((np.zeros(base), np.log10(self.masses + 1.0)))
        return self

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Of all tokens of a batch: places among the frequent words (-1 for others), symbols, and where each text starts;
        the other words, and the texts that they belong to."""
        words, of = split(texts)
        found = pc.index_in(words, value_set=self.index).fill_null(-1).to_numpy()
        sym = self.symbol[found]
        other = np.flatnonzero(found < 0)
        rest = words.take(pa.array(other)).dictionary_encode()
        if len(other):
            sym[other] = np.array([self.size - 2 * SHAPES + shape(w) for w in rest.dictionary.to_pylist()])[rest.indices.to_numpy()]
        ends = np.searchsorted(of, np.arange(len(texts)), "right")  # each text's end comes behind its words
        at, sym, docs = np.insert(found, ends, self.at_end), np.insert(sym, ends, self.end), of[other]
        rest = rest.cast(pa.binary())
        if self.at_end < 0:
            rest, docs = pa.concat_arrays([rest, pa.array([END] * len(texts), pa.binary())]), np.concatenate((docs, np.arange(len(texts))))
        return at, sym, np.concatenate(([0], (ends + np.arange(1, len(texts) + 1))[:-1])), rest, docs


_READY: dict[str, tuple[Lexicon, Gru | None]] = {}


def _loaded(held) -> tuple[Lexicon, Gru]:
    """The broadcast lexicon and model, prepared once for each worker process."""
    if held.id not in _READY:
        _READY.clear()
        lexicon, flat = held.value
        _READY[held.id] = lexicon.ready(), Gru(lexicon.freq(), lexicon.end).load(flat)
    return _READY[held.id]


class _Held:
    """A broadcast with an id of its own."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def _pieces(held: _Held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, _ = _loaded(held)
        for b in sliced(batches):
            hs, nums, out = [], [], []
            _, sym, starts, _, _ = lexicon.encode(b.column(1))
            for h, part in zip(b.column(0).to_pylist(), np.split(sym.astype(np.int16), starts[1:])):
                for k in range(0, len(part), PIECE):
                    hs.append(h)
                    nums.append(k)
                    out.append(part[max(0, k - LEAD) : k + PIECE].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(nums, pa.int32()), pa.array(out, pa.binary())], ["h", "at", "symbols"])

    return run


def _tune(held: _Held, tokens_each: int):
    lanes = min(LANES, max(16, tokens_each // 2_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket is learned in chunks."""
        lexicon, start = _loaded(held)
        bucket, model, fit, chunk, leads, waiting, seen = None, None, None, [], [], 0, 0

        def learn():
            nonlocal chunk, leads, waiting, seen
            model.learn(chunk, fit, lanes, leads)
            chunk, leads, waiting, seen = [], [], 0, seen + waiting

        def out():
            flat = model.weights
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.float64) * seen), pa.array(np.full(len(flat), seen, np.int64))], ["k", "x", "n"])

        for b in batches:
            for at, k, symbols in zip(b.column("bucket").to_pylist(), b.column("at").to_pylist(), b.column("symbols")):
                if at != bucket:
                    if bucket is not None:
                        learn()
                        yield out()
                    bucket, seen = at, 0
                    model = Gru(lexicon.freq(), lexicon.end).load(start.weights)
                    fit = Adam(model.weights, PASS_RATE, max(1, tokens_each // (lanes * WINDOW)))
                chunk.append(np.frombuffer(symbols.as_py(), np.int16))
                leads.append(min(k, LEAD))
                waiting += len(chunk[-1]) - leads[-1]
                if waiting >= CHUNK_TOKENS:
                    learn()
        if bucket is not None:
            learn()
            yield out()

    return run


def _score(held: _Held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = _loaded(held)
        unit = math.log10(lexicon.total + lexicon.types + 1)
        docs, told, waiting = [], [], 0

        def out():
            """Texts of many slices are scored side by side, as those of one don't fill the lanes beside its longest."""
            nonlocal docs, told, waiting
            scores, at = model.score(docs) / LOG10, 0
            for uid, n, known, base, within, rest in told:
                yield pa.RecordBatch.from_arrays([uid, pa.array(n), pa.array(known), pa.array(base), pa.array(scores[at : at + len(n)] + within), rest], ["uid", "n_tokens", "known", "base", "score", "rest"])
                at += len(n)
            docs, told, waiting = [], [], 0

        for b in sliced(batches):
            at, sym, starts, others, of = lexicon.encode(b.column(1))
            n, logs = np.diff(np.append(starts, len(at))), lexicon.log1[at]
            base = np.add.reduceat(logs, starts) - n * unit
            within = np.where(sym >= lexicon.size - 2 * SHAPES, logs - lexicon.norm[sym], 0.0)
            docs += np.split(sym.astype(np.int16), starts[1:])
            # Other words of each text, with how often it holds them.
            coded = others.dictionary_encode()
            types = max(1, len(coded.dictionary))
            keys, times = np.unique(of * types + coded.indices.to_numpy(), return_counts=True)
            pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(keys % types)), pa.array(times, pa.int64())], ["w", "k"])
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(keys // types, np.arange(b.num_rows + 1)), pa.int32()), pairs)
            told.append((b.column(0), n, np.add.reduceat((at >= 0).astype(np.int64), starts), base, np.add.reduceat(within, starts), rest))
            waiting += len(at)
            if waiting >= SCORE_TOKENS:
                yield from out()
        if told:
            yield from out()

    return run


def _least(hist: list, most: int) -> int:
    """The smallest count such that at most ``most`` words have it or more."""
    total, least = 0, 1 << 62
    for n, words in sorted(hist, reverse=True):
        if total + words > most:
            break
        total, least = total + words, n
    return least


def counted(train: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of every token of ``train``."""
    return cut(train.select(F.col(text).alias("text")).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def lexicon_of(counts: DataFrame) -> Lexicon:
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # At most about sqrt(2 * total) counts differ; the common ones are all that is asked for.
    hist = counts.groupBy("n").count().orderBy(F.desc("n")).limit(TOP).collect()
    top = counts.where(F.col("n") >= _least([tuple(r) for r in hist], TOP)).toArrow()
    found = sorted(zip(top.column("n").to_pylist(), top.column("word").to_pylist()), key=lambda x: (-x[0], x[1]))
    words, ns = [w for _, w in found], np.array([n for n, _ in found], np.int64)
    masses = np.zeros(2 * SHAPES)
    for r in counts.mapInArrow(_shapes, "shape int, mass long").groupBy("shape").sum("mass").collect():
        masses[r[0]] = r[1]
    for w, n in zip(words[:SYMBOLS], ns):
        masses[shape(w)] -= n + 1
    if END not in words[:SYMBOLS] and total:
        masses[shape(END)] -= counts.where(F.col("word") == F.lit(bytearray(END))).first()[1] + 1
    return Lexicon(words, ns, np.maximum(masses, 0), total, types)


def fit(train: DataFrame, lexicon: Lexicon, text: str = "text", key: str = "doc_id") -> np.ndarray:
    """Weights learned from ``train``; see the module's text."""
    model = Gru(lexicon.freq(), lexicon.end)
    h = F.xxhash64(F.lit(SEED), F.col(key))
    rows = train.select(h.alias("h"), F.col(text).alias("text"))
    count = rows.count()
    if not count:
        return model.flat()
    context = train.sparkSession.sparkContext
    # A sampled document's pieces are drawn from all of it, so a long text is not read by its beginning alone.
    part = min(1.0, 1.2 * WARM_DOCS / count)
    first = rows.where(F.pmod(F.col("h"), F.lit(1 << 30)) < part * (1 << 30)).mapInArrow(_pieces(_Held(context.broadcast((lexicon, model.flat())))), "h long, at int, symbols binary")
    drawn = first.orderBy(F.xxhash64("h", "at"), "h", "at", "symbols").limit(WARM_PIECES).collect()
    warm, taken = [], 0
    for r in drawn:
        if taken < WARM_TOKENS:
            warm.append((np.frombuffer(r["symbols"], np.int16), min(r["at"], LEAD)))
            taken += len(warm[-1][0]) - warm[-1][1]
    model.train([w for w, _ in warm], WARM_EPOCHS, WARM_RATE, leads=[n for _, n in warm])
    held = _Held(context.broadcast((lexicon, model.flat())))
    # Rows of one key and text, or of none, are pieces alike, so their order among themselves is no matter.
    buckets = max(1, min(BUCKETS, lexicon.total // BUCKET_TOKENS))
    pieces = train.select(F.xxhash64(F.lit(SEED), key, text).alias("h"), F.col(text).alias("text")).mapInArrow(_pieces(held), "h long, at int, symbols binary")
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("h", "at"), F.lit(buckets)).cast("int")).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "h", "at")
    learned = dealt.mapInArrow(_tune(held, lexicon.total // buckets), "k int, x double, n long")
    mean = learned.groupBy("k").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()  # a row for each weight
    if mean.num_rows == len(model.flat()):
        flat = np.empty(mean.num_rows, np.float32)
        flat[np.asarray(mean.column("k"))] = np.asarray(mean.column("x"))
        return flat
    return model.flat()


def score_texts(docs: DataFrame, train: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs``' keys with n_tokens, n_known, train_tokens, base_score and score, a row for each row."""
    counts = counted(train, text)
    lexicon = lexicon_of(counts)
    flat = fit(train, lexicon, text, key)
    held = _Held(docs.sparkSession.sparkContext.broadcast((lexicon, flat)))  # TOP words and the weights
    ids = docs.select(F.struct(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row")).alias("uid"), F.col(text).alias("text"))
    parts = cut(ids.mapInArrow(_score(held), "uid struct<key:long,row:long>, n_tokens long, known long, base double, score double, rest array<struct<w:binary,k:long>>"))
    rare = parts.select("uid", F.explode("rest").alias("r")).select("uid", F.col("r.w").alias("word"), F.col("r.k").alias("k"))
    found = rare.join(counts, "word").groupBy("uid").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("add"))
    more, add = F.coalesce("more", F.lit(0)), F.coalesce("add", F.lit(0.0))
    return parts.drop("rest").join(found, "uid", "left").select(F.col("uid.key").alias(key), "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"), (F.col("base") + add).alias("base_score"), (F.col("score") + add).alias("score"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = fold(F.col("doc_id"), FOLDS)
    out = score_texts(docs, docs.where(remainder != HELD_OUT))
    return out.select("doc_id", (remainder == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op6_lm_score": op6_lm_score}
SQL: dict[str, str] = {}
