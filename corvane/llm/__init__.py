"""Operators for large training-data pipelines, thirteen in all.

Nothing else in the library imports this subpackage. Each module holds one operator with a general
interface and a thin ``opN_*`` query; :func:`queries` and :func:`oracle_sql` gather those queries.
"""

from __future__ import annotations


def _modules():
    from . import (
        decontaminate,
        fingerprints,
        language_id,
        line_dedup,
        lm_score,
        hard_negatives,
        pieces,
        prefix_trie,
        secret_scan,
        sharding,
        simhash,
        toxicity,
        warc,
    )

    return (language_id, pieces, lm_score, fingerprints, simhash, toxicity, line_dedup, warc, decontaminate, sharding, secret_scan, hard_negatives, prefix_trie)


def queries() -> dict:
    """Query name -> callable(spark, sf_dir)."""
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    """Query name -> DuckDB SQL, for the queries that SQL can express."""
    return {k: s for m in _modules() for k, s in m.ORACLE_SQL.items()}
