"""Queries over the driver's tables, registered where their modules are imported."""

from . import catalogue, decisions

__all__ = ["catalogue", "decisions"]
