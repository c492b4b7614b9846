"""All queries over the driver's tables, with their SQL, by operator id."""

from __future__ import annotations

import importlib

from ._register import QUERIES, SQL

for _module in ("flagship", "contract_queries", "join_queries", "aggregate_queries", "scalar_queries", "model_queries", "gradient_queries", "longrow_queries", "boundary_queries", "source_queries", "stream_queries", "extra_queries"):
    importlib.import_module(f"{__package__}.{_module}")

__all__ = ["QUERIES", "SQL"]
