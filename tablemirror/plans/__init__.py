"""All registered queries."""

from tablemirror.plans import (  # noqa: F401
    board_queries, closed_form_queries, compare_queries, encode_queries, profile_queries, sample_queries, score_queries, utility_queries)
from tablemirror.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
