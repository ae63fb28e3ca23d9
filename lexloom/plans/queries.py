"""All queries of the library but those of its separate subpackage for training text."""

from __future__ import annotations

from . import clean, grammar, morph, segment, sources  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
