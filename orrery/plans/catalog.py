"""The registered queries of the engine and the SQL they are compared with."""

from __future__ import annotations

from orrery.plans import aggregates, filters, geometry, graphs, joining, projections, storage, texts, windows  # noqa: F401  (they register)
from orrery.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "AGG02_depth_prior"
