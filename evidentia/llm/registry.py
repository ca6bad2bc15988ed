"""All queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, divergence, fim, html, langid, lm, minhash, mixing, quality, repeats, sharding, toxicity

MODULES = [chat, decontaminate, divergence, fim, html, langid, lm, minhash, mixing, quality, repeats, sharding, toxicity]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
