"""Query keys with their Spark callables and DuckDB checks."""

from icuflow.catalog import aggregates, basics, extracts, features, joins, models, ordering, sampling, scalars, scores  # noqa: F401
from icuflow.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
