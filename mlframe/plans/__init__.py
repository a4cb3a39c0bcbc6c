"""Registered queries, grouped as in the survey."""

from mlframe.plans import (  # noqa: F401
    clean_queries,
    encode_queries,
    metric_queries,
    model_queries,
    profile_queries,
    publish_queries,
    sequence_queries,
    split_queries,
    text_queries,
)
from mlframe.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
