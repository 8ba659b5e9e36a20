"""All registered queries of the library."""

from stumpwright.plans import dataset_queries, detect_queries, patch_queries, storage_queries, stream_queries  # noqa: F401
from stumpwright.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
