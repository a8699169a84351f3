"""Registered queries over the driver tables and the SQL they are checked against."""

from importlib import import_module

MODULES = (
    "curves",
    "selection",
    "decisions",
    "resampling",
    "gating",
    "splits",
    "boxes",
    "audits",
    "storage",
    "learning",
    "contracts",
)


def load():
    """All queries and reference SQL."""
    from workload.registry import ORACLES, QUERIES

    for module in MODULES:
        import_module(f"workload.{module}")
    return dict(QUERIES), dict(ORACLES)
