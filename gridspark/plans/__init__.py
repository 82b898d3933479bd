"""Registered queries: every operator run over tables derived from the given data."""

from importlib import import_module

from gridspark.plans.registry import ORACLES, QUERIES

_MODULES = ["sources_select", "joins", "aggregates", "windows", "texts", "times", "generators"]


def load() -> None:
    """Import all query modules so that they register themselves."""
    for name in _MODULES:
        import_module(f"gridspark.plans.{name}")


__all__ = ["ORACLES", "QUERIES", "load"]
