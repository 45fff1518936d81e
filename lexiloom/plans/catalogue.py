"""Importing this module registers every query."""

from lexiloom.plans import (  # noqa: F401
    example_queries,
    file_queries,
    mining_queries,
    parallel_queries,
    profile_queries,
    segment_queries,
    split_queries,
    stream_queries,
    text_queries,
    vector_queries,
)
from lexiloom.plans.registry import QUERIES, SQL  # noqa: F401
