"""Registry of runnable queries, one per operator, each with its SQL check where SQL can say it."""

from tidemark.catalog.base import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
