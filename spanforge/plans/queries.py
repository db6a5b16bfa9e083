"""All registered queries: importing a family's module registers it."""

from . import backfills, checks, corpus, scores, texts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
