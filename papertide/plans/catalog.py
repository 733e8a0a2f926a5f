"""All queries of the library: importing the modules registers them."""

from __future__ import annotations

from papertide.plans import landed, printed, records, resolved
from papertide.plans.registry import FLAGSHIP, oracle_sql, queries

__all__ = ["FLAGSHIP", "landed", "oracle_sql", "printed", "queries", "records", "resolved"]
