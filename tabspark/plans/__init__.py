"""Registered queries: each operator family bound to the given tables."""

from __future__ import annotations

import importlib

FAMILIES = ("layout", "attach", "rhythm", "songs", "library", "feeds")


def load():
    """(queries, SQL) by name."""
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    from .registry import QUERIES, SQL

    return QUERIES, SQL
