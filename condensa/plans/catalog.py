"""All registered queries. Importing the query modules fills the registry."""

from __future__ import annotations

from . import q_blocks, q_json, q_normalise, q_report, q_results, q_session, q_snapshot, q_stream, q_text  # noqa: F401
from .registry import ORACLES, QUERIES


def flagship(spark, sf_dir):
    if "reduce_results" in QUERIES:
        return QUERIES["reduce_results"](spark, sf_dir)
    return QUERIES["block_inventory"](spark, sf_dir)


__all__ = ["QUERIES", "ORACLES", "flagship"]
