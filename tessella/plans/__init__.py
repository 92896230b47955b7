"""The registered queries of the engine and their SQL."""

from . import collection_queries, scale_queries  # noqa: F401  register their queries
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
