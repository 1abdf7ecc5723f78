"""All of the engine's own queries by name, and their SQL."""

from __future__ import annotations

from recollect.plans import analytics, answers, graphs, ingest, ledgers, notes, retrieval, sequences, state, tapes  # noqa: F401  they register their queries
from recollect.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
