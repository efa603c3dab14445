"""Every registered query and its SQL."""

from __future__ import annotations

from scorebook.plans import (  # noqa: F401  (imported to register their queries)
    book_queries,
    contract_queries,
    disclosure_queries,
    model_queries,
    quality_queries,
    segment_queries,
)
from scorebook.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
