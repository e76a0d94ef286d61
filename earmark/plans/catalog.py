"""Importing this module registers every query."""

from earmark.plans import (  # noqa: F401
    episode_queries,
    evidence_queries,
    search_queries,
    source_queries,
    timeline_queries,
    transcript_queries,
)
from earmark.plans import stream_queries  # noqa: F401  (builds on the ones above)
from earmark.plans.registry import QUERIES, SQL  # noqa: F401
