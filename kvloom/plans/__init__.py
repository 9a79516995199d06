"""All registered queries."""

from . import control_queries, decision_queries, log_queries, storage_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "control_queries", "decision_queries", "log_queries", "storage_queries"]
