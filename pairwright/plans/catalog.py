"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from pairwright.plans import io_plans, labelling, reporting, summary_plans, synthesis_plans, validation_plans

_PARTS = (labelling, reporting, synthesis_plans, validation_plans, io_plans, summary_plans)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in _PARTS for k, v in p.ORACLES.items()}
