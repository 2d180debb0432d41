"""Imports every plan module, which fills the registry."""

from importlib import import_module

MODULES = ["filters", "joins", "sets", "aggregates", "fuel", "series", "anomalies", "insights", "limits", "rules", "reconcile", "corrections", "geo", "metrics", "text", "consensus", "streams"]

for _name in MODULES:
    import_module(f"spendlake.plans.{_name}")

from spendlake.plans.registry import ORACLES, QUERIES, callables  # noqa: E402

__all__ = ["ORACLES", "QUERIES", "callables"]
