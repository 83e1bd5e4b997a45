"""All queries of the document operators by name."""

from __future__ import annotations

from textloom.plans import pages, samples, texts


def queries() -> dict:
    return {**texts.QUERIES, **pages.QUERIES, **samples.QUERIES}


def oracle_sql() -> dict:
    return {**texts.SQL, **pages.SQL, **samples.SQL}
