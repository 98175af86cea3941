"""All registered queries (one per operator slug of the survey) and their
DuckDB twins. Each query takes (spark, sf_dir) and reads the driver tables."""

from __future__ import annotations

from vellum.plans import corpus_q, io_q, records_q, scores_q, vectors_q

FAMILIES = [corpus_q, scores_q, records_q, vectors_q, io_q]


def queries() -> dict:
    out: dict = {}
    for fam in FAMILIES:
        out.update(fam.Q)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for fam in FAMILIES:
        out.update(fam.SQL)
    return out
