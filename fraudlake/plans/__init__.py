"""Registered queries (one per operator of SURVEY section 2) and their oracles."""

from fraudlake.plans import (  # noqa: F401
    q_explain, q_ingest, q_metrics, q_monitor, q_prepare, q_privacy, q_private, q_rounds, q_sample, q_split,
    q_stream,
    q_trends)
from fraudlake.plans.registry import ORACLE, QUERIES, SURVEY_ID  # noqa: F401
