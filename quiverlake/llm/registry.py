"""Queries of the corpus operators, by name, and their SQL."""

from __future__ import annotations

import importlib

#: Modules of this subpackage that hold QUERIES and ORACLE.
MODULES = ["simhash", "repeats", "decontaminate", "bpe_text", "page_text", "ngram_lm", "token_files", "toxicity", "url_rules", "gif_media"]


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
