"""Driver-facing query plans. Importing this package registers every query."""

from . import q_answers, q_ingest, q_pages, q_reads, q_scoring, q_similarity, q_streams, q_summaries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
