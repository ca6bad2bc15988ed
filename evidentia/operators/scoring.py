"""Scores from severities: a saturating product in which each weaker finding counts for less."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECAY, MALICIOUS, SUSPICIOUS = 0.6, 70, 35


def score(severities: Column) -> Column:
    """0 to 100: 100 less 100 * product(1 - severity / 100 * 0.6^rank), strongest first, rounded half to even."""
    start = F.struct(F.lit(100.0).alias("rem"), F.lit(1.0).alias("w"))
    step = lambda a, x: F.struct((a["rem"] * (F.lit(1.0) - (x / F.lit(100.0)) * a["w"])).alias("rem"), (a["w"] * F.lit(DECAY)).alias("w"))
    return F.bround(F.lit(100.0) - F.aggregate(F.sort_array(severities, asc=False), start, step, lambda a: a["rem"])).cast("int")


def level(value: Column) -> Column:
    return F.when(value >= MALICIOUS, "malicious").when(value >= SUSPICIOUS, "suspicious").otherwise("benign")


def confidence_of(top: int, corroborating: int) -> float:
    """Two decimals of a double, as only the double itself rounds; hence a table instead of an expression."""
    return round(min(0.95, 0.35 + 0.45 * (top / 100.0) + 0.20 * (min(corroborating, 4) / 4.0)), 2)


_TABLE = [[confidence_of(t, k) for k in range(5)] for t in range(101)]


def confidence(severities: Column) -> Column:
    """0.5 without findings, else by the strongest and by how many of 40 or more stand beside it."""
    top = F.array_max(severities)
    strong = F.least(F.size(F.filter(severities, lambda s: s >= 40)), F.lit(4))
    table = F.array(*[F.lit(x) for row in _TABLE for x in row])
    return F.when(F.size(severities) == 0, 0.5).otherwise(F.get(table, top * 5 + strong))


def real_severities(signatures: Column) -> Column:
    return F.transform(F.filter(signatures, lambda s: s["id"] != "RULE_ERROR"), lambda s: s["severity"])


def judge(df: DataFrame, signatures: str = "signatures") -> DataFrame:
    """``df`` plus score, level and confidence of its fired rules."""
    s = real_severities(F.col(signatures))
    return df.withColumn("score", score(s)).withColumn("level", level(F.col("score"))).withColumn("confidence", confidence(s))


LEVELS = ["benign", "suspicious", "malicious"]


def rank(level: Column) -> Column:
    out = None
    for i, k in enumerate(LEVELS):
        out = F.when(level == k, i) if out is None else out.when(level == k, i)
    return out
