"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import connectors, datasets, geometric, mapping, sequences, services, streams  # noqa: F401  (registers its queries)
from .plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "voxel_map"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
