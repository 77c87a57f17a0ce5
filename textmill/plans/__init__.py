"""Registered queries; importing this package registers them all."""

from textmill.plans import hybrid, matches, ranking, relational, selection, spans, storage, structure, telemetry, texts  # noqa: F401
from textmill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
