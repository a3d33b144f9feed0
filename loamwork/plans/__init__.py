"""Named queries: each binds an operator to the driver's tables, with SQL for the same rows."""

from . import registry
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load"]


def load() -> None:
    """Import all families, which fills the registry."""
    registry.load()
