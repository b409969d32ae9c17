"""Registered queries: every operator bound to the test tables through role views."""

from importlib import import_module

MODULES = (
    "sources", "cleaning", "joins", "aggregates", "rain", "ordering", "functions", "terrain", "indexes", "checks", "models", "streams", "charts",
)


def load_all() -> None:
    for name in MODULES:
        import_module(f"rillgrid.plans.{name}_queries")
