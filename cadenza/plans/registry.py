"""All registered queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ("sources", "filters", "joins", "aggregates", "windows", "topk", "signal", "rhythm", "entropy", "similarity", "text", "streaming")
QUERIES: dict = {}
ORACLE: dict = {}

for _name in MODULES:
    _module = importlib.import_module(f"cadenza.plans.{_name}_plans")
    QUERIES |= _module.PLANS.queries
    ORACLE |= _module.PLANS.oracle
