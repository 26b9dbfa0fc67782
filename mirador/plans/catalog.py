"""The core's queries and their SQL."""

from __future__ import annotations

from . import format_queries, point_queries, relational_queries, scalar_queries  # noqa: F401 - they register their queries
from .core import QUERIES, SQL  # noqa: F401
