"""Registered queries."""

from fieldlab.plans import assembly, composition, corruption, evaluation, selection  # noqa: F401
from fieldlab.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
