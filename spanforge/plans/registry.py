"""Where registered queries and their SQL are kept."""

from __future__ import annotations

from .fixtures import PRELUDE

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True):
    """Registers a query under its function's name; sql follows the prelude's CTEs."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (PRELUDE if prelude else "") + sql
        return f

    return keep
