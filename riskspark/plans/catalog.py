"""Import every query module so the registry is complete."""

from __future__ import annotations

import importlib

MODULES = (
    "q_features",
    "q_online",
    "q_decide",
    "q_dashboard",
    "q_evaluate",
    "q_monitor",
    "q_datasets",
    "q_sources",
    "q_streaming",
    "q_train",
)


def load():
    from riskspark.plans.registry import ORACLE, QUERIES

    for m in MODULES:
        importlib.import_module(f"riskspark.plans.{m}")
    return QUERIES, ORACLE
