"""The registered queries of the library, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from loadgrid.plans import interval_queries, release_queries, score_queries, series_queries, window_queries

QUERIES: dict = {}
ORACLE: dict = {}
for _part in (interval_queries, series_queries, window_queries, score_queries, release_queries):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE


def entry(spark, sf_dir):
    """The flagship query."""
    return QUERIES["e7_coverage_summary"](spark, sf_dir)
