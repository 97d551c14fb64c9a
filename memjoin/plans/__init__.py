"""Registered queries over the supplied tables, one module per operator family."""

from __future__ import annotations

import importlib

MODULES = (
    "lexical", "scalars", "vectors", "metadata", "graphs", "fields", "packing", "metrics", "rollups", "hashed", "basins", "ingest",
    "augment", "features", "feedback", "online", "learned",
)


def load_all():
    from memjoin.plans.registry import REGISTRY

    for name in MODULES:
        importlib.import_module(f"memjoin.plans.{name}")
    return REGISTRY
