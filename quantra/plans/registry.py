"""Every query of the pricing and tender operators, with its SQL."""

from __future__ import annotations

from quantra.plans import queries_grid, queries_library, queries_pricing, queries_tender

QUERIES = {**queries_pricing.QUERIES, **queries_library.QUERIES, **queries_grid.QUERIES, **queries_tender.QUERIES}
ORACLES = {**queries_pricing.ORACLES, **queries_library.ORACLES, **queries_grid.ORACLES, **queries_tender.ORACLES}
