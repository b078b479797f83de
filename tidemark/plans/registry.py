"""Queries of the library and their DuckDB counterparts, by name."""

from . import datasets, measures, series

QUERIES = {**series.QUERIES, **datasets.QUERIES, **measures.QUERIES}
ORACLES = {**series.ORACLES, **datasets.ORACLES, **measures.ORACLES}
