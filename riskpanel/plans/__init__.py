"""Registered queries: each pairs a Spark job over the given tables with, where SQL can say it, the same in SQL."""

from importlib import import_module

FAMILIES = ("sources", "transforms", "describe", "connectedness", "component", "dynamics", "crosssection", "risk",
            "comparison")


def load() -> dict:
    """Import every family of queries and return the registry."""
    for family in FAMILIES:
        import_module(f"riskpanel.plans.{family}")
    from riskpanel.plans.registry import REGISTRY
    return dict(REGISTRY)
