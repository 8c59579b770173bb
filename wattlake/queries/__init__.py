"""Registered queries over the test tables, each next to its SQL oracle."""

from wattlake.queries import (  # noqa: F401
    aggregates,
    domain,
    functions,
    joins,
    measures,
    projections,
    quality,
    risk,
    sinks,
    sources,
    statistics,
    streams,
    windows,
)
from wattlake.queries.registry import ORACLES, QUERIES  # noqa: F401
