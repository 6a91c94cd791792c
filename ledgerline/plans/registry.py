"""Every registered query of the library and its SQL."""

from __future__ import annotations

from . import queries_features, queries_lists, queries_models, queries_scores, queries_text  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
