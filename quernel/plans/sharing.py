"""Whose stored values may be shown."""

from __future__ import annotations

from quernel.catalog import PUBLIC, Catalog


def rows_shareable(columns: list[tuple[str, str]], catalog: Catalog, shared: frozenset[tuple[str, str]] | set[tuple[str, str]]) -> bool:
    """Whether the rows of a query that reads these (table, column) pairs may be shown: all are public and shared.

    COUNT(*) alone reads no column, so its rows may.
    """
    for table, name in columns:
        t = catalog.table(table)
        c = t.column(name) if t else None
        if c is None or c.sensitivity != PUBLIC or (table, name) not in shared:
            return False
    return True
