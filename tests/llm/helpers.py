"""Small tables for the corpus operators: nulls in every column, empty and long texts, ties, repeated rows, odd extra columns."""

import random
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def odd_docs(spark):
    base = prose(200, 1)
    rows = [(1, base, "en", "src1", 1, "x", "y"), (2, base, "en", "src1", 1, None, None), (2, base, "en", "src1", 1, None, None), (3, None, None, None, None, None, None), (4, "", "de", "src2", 0, "a", "b"), (None, "a null id", None, "src3", 3, None, None), (5, " \n\t ", "fr", None, 1, None, None), (6, prose(40_000, 2), "en", "src1", 9, None, None), (7, "one", "es", "src4", 3, None, None), (8, base + " tail words here", "en", "src1", 1, None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def save(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
