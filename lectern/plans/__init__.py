"""All registered queries."""

from lectern.plans import chat, ingest, pages, retrieval, text  # noqa: F401
from lectern.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
