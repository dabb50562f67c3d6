"""Named queries over the driver's tables, each with a SQL twin where one can be written."""

from __future__ import annotations

from fleetlens.catalog import (  # noqa: F401  (importing registers the queries)
    alerting,
    cleaning,
    expressions,
    forecasting,
    joining,
    logging,
    scalars,
    sinks,
    sizing,
    sources,
    streams,
)
from fleetlens.catalog.registry import ORACLES, QUERIES
from fleetlens.catalog.sql import expand

TWINS = {name: expand(sql) for name, sql in ORACLES.items()}

__all__ = ["QUERIES", "TWINS"]
