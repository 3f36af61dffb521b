"""All queries of the outfit engine with their SQL."""

from __future__ import annotations

from . import agreement, benchmark, documents, external, files, legacy, reports, retrieval  # noqa: F401  they register their queries
from .domain import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
