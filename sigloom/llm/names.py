"""Names of working columns that no column of a table has."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores before those that are taken, in any case of letters."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
