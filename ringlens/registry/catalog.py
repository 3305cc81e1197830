"""Importing this module registers every query."""

from __future__ import annotations

from ringlens.registry import behaviour, checks, evaluation, evidence, graph, summaries  # noqa: F401  # isort: skip
from ringlens.registry import communities, models  # noqa: F401  # isort: skip
from ringlens.registry.base import REGISTRY

__all__ = ["REGISTRY"]
