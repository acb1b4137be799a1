"""All registered queries."""

from rollbook.plans import (  # noqa: F401
    block_queries,
    catalog,
    flagship,
    ledger_queries,
    snapshot_queries,
    stream_queries,
)
from rollbook.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
