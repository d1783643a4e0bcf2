"""Registered queries: every operator applied to the shared tables, with its SQL where SQL can say it."""

from flowcairn.catalog import decisions, distributions, feeds, learning, preparation, statistics, streams  # noqa: F401
from flowcairn.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
