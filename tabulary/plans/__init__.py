"""Named queries over the test tables, each beside the SQL that must agree with it."""

from importlib import import_module
from types import ModuleType

GROUPS = (
    "tables",
    "profiles",
    "statistics",
    "charts",
    "analyses",
    "questions",
    "searching",
    "chunking",
    "talks",
)


def load() -> ModuleType:
    """The catalogue with every group of queries in it."""
    for group in GROUPS:
        import_module(f"tabulary.plans.{group}")
    return import_module("tabulary.plans.catalogue")
