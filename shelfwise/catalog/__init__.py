"""Every operator as a runnable query over the test tables, with its SQL twin."""

from __future__ import annotations

from importlib import import_module

AREAS = ("profiling", "quality", "joining", "querying", "commerce", "taxonomies", "asking", "texts")


def load():
    """(queries, SQL) by name."""
    for area in AREAS:
        import_module(f"shelfwise.catalog.{area}")
    from shelfwise.catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
