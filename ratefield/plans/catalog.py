"""All queries of the rate engine."""

from __future__ import annotations

from ratefield.plans import products, relational, reports, sources, statistical

QUERIES = relational.QUERIES | statistical.QUERIES | products.QUERIES | sources.QUERIES | reports.QUERIES
ORACLES = relational.ORACLES | statistical.ORACLES | products.ORACLES | sources.ORACLES | reports.ORACLES
