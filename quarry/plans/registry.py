"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import answers, evaluation, graphs, retrieval, sessions, streams, structure, texts  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
