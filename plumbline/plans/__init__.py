"""Registered queries, one module per section of the operator inventory."""
from __future__ import annotations

from importlib import import_module

SECTIONS = (
    "sources", "scalars", "joins", "aggregations", "windows", "partitions", "features", "clusters", "inference",
    "models", "selection", "pairs", "checks",
)


def all_queries():
    from plumbline.plans.registry import QUERIES

    for s in SECTIONS:
        import_module(f"plumbline.plans.{s}")
    return QUERIES
