"""Named queries over the supplied tables, family by family, and their SQL."""

from . import code, graph, history, learning, reports, retrieval, sessions, tables
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "code", "graph", "history", "learning", "reports", "retrieval", "sessions", "tables"]
