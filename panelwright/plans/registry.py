"""All registered queries and their SQL."""

from __future__ import annotations

from . import cohorts, features, jobs, joins, models, panels, quality, ranked, reports, shares, tables

FLAGSHIP = "d2_lagged_panel"
QUERIES: dict = {}
ORACLES: dict = {}
for module in (tables, panels, joins, ranked, shares, reports, quality, features, models, cohorts, jobs):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
