"""Language identification by compression.

For each language, whole training texts are gathered into a zstandard raw-content dictionary. A text is compressed with
every dictionary, and the language whose dictionary leaves the fewest bytes wins; the answer is rejected when the margin
between the two smallest sizes is narrow. Long texts are compressed whole.

Fitting reads a bounded sample: of each language the ``SAMPLE_TEXTS`` training texts with the smallest seeded hashes (about a fifth more are read), up
to ``DICT_BYTES`` bytes. Case is folded, digits and symbols are dropped, so junk around words doesn't decide.
Ties go to the language whose name sorts first. ``UND`` is the answer for a null text or one without a letter, and
for every text if no row trains. Repeated rows count as often as they occur. Extra columns ride along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, named, table

UND = "und"
SAMPLE_TEXTS, DICT_BYTES = 200, 64_000
LEVEL = 6
SEED = 5
#: Rejected when the winner saves less than this share of the runner-up's bytes.
MARGIN = 0.02
FOLDS, HELD_OUT = 5, 0
_KEEP = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def normal(text: str) -> str:
    """Letters alone, in lower case, each run of anything else one space."""
    return _KEEP.sub(" ", text).strip().lower()


def fit(train: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", texts: int = SAMPLE_TEXTS, size: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary for each language of ``train``; about 1.2 * ``texts`` rows of each language are read by the driver."""
    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(F.lit(SEED), F.col(order)).alias("h"), F.col(text).alias("text"))
    share = {r["lang"]: min(1.0, 1.2 * texts / r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return {}
    wanted = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, v)])
    sample = rows.where(F.pmod(F.col("h"), F.lit(1 << 30)) < F.element_at(wanted, F.col("lang")) * (1 << 30))
    picked: dict[str, list] = {}
    for r in sample.select("lang", "h", F.substring("text", 1, size).alias("text")).collect():
        picked.setdefault(r["lang"], []).append((r["h"], r["text"]))
    out = {}
    for k, found in picked.items():
        parts = [normal(t) for _, t in sorted(found)[:texts]]
        data, used = [], 0
        for p in parts:
            b = (p + " ").encode("utf-8", "ignore")
            data.append(b)
            used += len(b)
            if used >= size:
                break
        if whole := b"".join(data)[-size:]:
            out[k] = whole
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(dictionaries)
        self.by = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        plain = normal(text) if text else ""
        if not self.langs or not _LETTER.search(plain):
            return UND, 0.0, True
        data = plain.encode("utf-8", "ignore")
        sizes = [len(c.compress(data)) for c in self.by]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0, False
        other = min(s for i, s in enumerate(sizes) if i != best)
        gain = (other - sizes[best]) / max(other, 1)
        # Odds from the bits saved, tempered, as sizes are whole bytes and neighbouring words aren't independent.
        odds = [math.exp(-min(60.0, (s - sizes[best]) / 4)) for s in sizes]
        return self.langs[best], 1 / sum(odds), gain < MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred, score and rejected; columns of those names are replaced."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    schema = ", ".join([*["`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in docs.select(*map(named, keep)).schema], "lang_pred string", "score double", "rejected boolean"])
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)  # DICT_BYTES for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(held.value)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(keep.index(text))]
            extra = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*keep, "lang_pred", "score", "rejected"])

    return docs.select(*map(named, keep)).mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = fold(F.col("doc_id"), FOLDS)
    dictionaries = fit(docs.where(remainder != HELD_OUT))
    found = identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", (remainder == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op3_language_id": op3_language_id}
SQL: dict[str, str] = {}
