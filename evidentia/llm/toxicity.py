"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words without outer punctuation, hashed to ``2^BITS`` features. The score is
sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>): pairs of terms, an insult and a group's name say, count beyond what each
says alone. Weights are learned by AdaGrad with soft thresholding; v starts at small random values.

Fitting reads at most ``TRAIN_ROWS`` labelled rows, those with the smallest seeded hashes, so its cost has a bound; every
text is scored whole. Features that fewer than ``MIN_ROWS`` training rows hold stay at zero, and so do those that neither go
with the label alone nor matter in pairs: a first machine over all features, strongly shrunk, finds the latter (:func:`paired`). The threshold ``CUT`` belongs to
the contract; scores are calibrated on the training rows by a bias and a slope alone.

Null and empty texts have no terms and score the intercept. Labels that are null are left out; a label row without a
document trains nothing, and repeated labels count each. Without both classes in training every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, named, table

BITS, FACTORS = 18, 8
TRAIN_ROWS = 20_000
MIN_ROWS = 3
#: Least log-likelihood ratio with the label, on the training rows, of a feature that gets weights for itself.
SCREEN = 12.0
EPOCHS, RATE, SHRINK, SEED = 12, 0.15, 4e-4, 11
#: The first machine, and the least norm of factors that counts as needed.
SCOUT_EPOCHS, SCOUT_SHRINK, SCOUT_LEAST = 4, 2e-3, 0.1
FOLDS, HELD_OUT = 3, 1
CUT = 0.7
CACHE_WORDS = 300_000
_EDGES = b".,;:!?\"'()[]{}*#$%&|<>"


class Terms(dict):
    """Features of words, kept while there are few; -1 for a word of punctuation alone."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        bare = word.strip(_EDGES)
        out = self[word] = xxhash.xxh64_intdigest(bare) >> (64 - BITS) if bare else -1
        return out


def terms(text: str | None, known: Terms) -> np.ndarray:
    """Sorted distinct features of a whole text."""
    ws = set(text.encode("utf-8", "surrogatepass").lower().split()) if text else ()
    a = np.unique(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)))
    return a[1:] if len(a) and a[0] < 0 else a


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores before the sigmoid, all rows of a batch at once."""
        out = np.full(len(rows), self.bias, np.float64)
        full = [i for i, r in enumerate(rows) if len(r)]
        if full:
            flat = np.concatenate([rows[i] for i in full])
            at = np.concatenate(([0], np.cumsum([len(rows[i]) for i in full])[:-1]))
            v = self.v[flat]
            s = np.add.reduceat(v, at, 0)
            out[full] += np.add.reduceat(self.w[flat], at) + 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), at))
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(rows) + self.shift, -30, 30)))


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of y on z, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, h = p - y, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(r * z).mean() + 1e-3 * (a - 1), r.mean()])
        m = np.array([[(h * z * z).mean() + 1e-3, (h * z).mean()], [(h * z).mean(), h.mean() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(np.clip(a, 0.2, 8.0)), float(b)


def counts(rows: list[np.ndarray], weights: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows' weights for each feature, a block of rows at a time."""
    out = np.zeros(size)
    for k in range(0, len(rows), 1_000):
        part = rows[k : k + 1_000]
        out += np.bincount(np.concatenate(part), np.repeat(weights[k : k + 1_000], [len(r) for r in part]), size)
    return out


def association(rows: list[np.ndarray], y: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each feature and the label."""
    hit = counts(rows, y, len(seen))

    def part(k, n):  # k successes of n against the rate that they have
        p = k / np.maximum(n, 1)
        return np.where(k > 0, k * np.log(np.maximum(p, 1e-12)), 0) + np.where(n - k > 0, (n - k) * np.log(np.maximum(1 - p, 1e-12)), 0)

    n, k = len(y), y.sum()
    return 2 * (part(hit, seen) + part(k - hit, n - seen) - part(k, n))


def _descend(rows: list[np.ndarray], y: np.ndarray, use: np.ndarray, epochs: int, shrink: float) -> Machine:
    """AdaGrad over the features in ``use``; the others' weights stay at zero."""
    size, rng = len(use), np.random.default_rng(SEED)
    rows = [r[use[r]] for r in rows]
    bias, w = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(size)
    v = np.where(use[:, None], rng.normal(0, 0.01, (size, FACTORS)), 0.0)
    gw, gv, gb = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    order = np.arange(len(rows))
    batch = max(1, min(32, len(rows) // 64))
    for _ in range(epochs):
        rng.shuffle(order)
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            z = Machine(bias, w, v).raw([rows[i] for i in part])
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            gb += float((e * e).sum())
            bias -= RATE * float(e.sum()) / np.sqrt(gb)
            lens = [len(rows[i]) for i in part]
            if not sum(lens):
                continue
            flat = np.concatenate([rows[i] for i in part])
            err = np.repeat(e, lens)
            at = np.flatnonzero(np.array(lens))
            starts = np.concatenate(([0], np.cumsum(lens)[:-1]))[at]
            s = np.repeat(np.add.reduceat(v[flat], starts, 0), np.array(lens)[at], 0)
            ids, where = np.unique(flat, return_inverse=True)
            dw = np.bincount(where, err, len(ids))
            dv = np.stack([np.bincount(where, err * (s[:, f] - v[flat, f]), len(ids)) for f in range(FACTORS)], 1)
            gw[ids] += dw * dw
            gv[ids] += dv * dv
            rate = RATE / np.sqrt(gw[ids])
            u = w[ids] - rate * dw
            w[ids] = np.sign(u) * np.maximum(np.abs(u) - rate * shrink * len(part), 0)
            rate = 0.3 * RATE / np.sqrt(gv[ids])
            u = v[ids] - rate * np.clip(dv, -5, 5)
            v[ids] = np.sign(u) * np.maximum(np.abs(u) - rate * shrink * len(part), 0)
    return Machine(bias, w.astype(np.float32), v.astype(np.float32))


def paired(rows: list[np.ndarray], y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Features that a machine over all of ``use``, under strong shrinkage, needs for their pairs: a term may be neutral alone and tell in company."""
    norm = np.sqrt((_descend(rows, y, use, SCOUT_EPOCHS, SCOUT_SHRINK).v ** 2).sum(1))
    return norm >= max(SCOUT_LEAST, 0.5 * float(norm.max()))


def learn(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Machine:
    size, y = 1 << BITS, labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Machine(-30.0, np.zeros(size), np.zeros((size, FACTORS)))
    seen = counts(rows, np.ones(len(rows)), size)
    often = seen >= MIN_ROWS
    m = _descend(rows, y, often & ((association(rows, y, seen) >= SCREEN) | paired(rows, y, often)), epochs, SHRINK)
    m.slope, m.shift = _calibrate(np.concatenate([m.raw(rows[k : k + 256]) for k in range(0, len(rows), 256)]), y)
    return m


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, toxic): the rows to learn from."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64(F.lit(SEED), "doc_id").alias("_order"))
    picked = known.orderBy("_order", "doc_id", "toxic").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most train_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Terms()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([terms(t.as_py(), cache).astype(np.int32) for t in b.column(2)], pa.list_(pa.int32()))], ["k", "toxic", "terms"])

    got = rows.select("_order", "toxic", "text").mapInArrow(run, "k long, toxic int, terms array<int>").orderBy("k", "toxic", F.xxhash64("terms")).limit(train_rows).toArrow()  # repeated ids give more rows
    flat = got.column("terms").combine_chunks()
    return learn([np.asarray(x.values) if x.is_valid else np.empty(0, np.int32) for x in flat], np.asarray(got.column("toxic")))


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``docs`` plus ``score`` and ``predicted``; columns of those names are replaced."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = ", ".join([*["`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in docs.select(*map(named, keep)).schema], "score double", "predicted int"])
    held = docs.sparkSession.sparkContext.broadcast(machine)  # 2^BITS * (FACTORS + 1) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, m = Terms(), held.value
        for b in batches:
            texts, found = b.column(keep.index(text)), []
            for k in range(0, len(texts), 256):
                found.append(m.scores([terms(t.as_py(), cache) for t in texts[k : k + 256]]))
            s = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(*map(named, keep)).mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = fold(F.col("doc_id"), FOLDS)
    machine = fit(docs, table(spark, sf_dir, "labels").where(remainder != HELD_OUT))
    return score(docs, machine).select("doc_id", (remainder == HELD_OUT).alias("held_out"), "score", "predicted")


QUERIES = {"op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
