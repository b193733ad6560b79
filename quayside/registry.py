"""Every registered query and, where SQL can express it, its DuckDB SQL."""

from __future__ import annotations

from quayside.plans import facts, features, records, reductions  # noqa: F401  (registers its queries)
from quayside.plans.market import ORACLES as _ORACLES
from quayside.plans.market import QUERIES as _QUERIES

QUERIES = {**_QUERIES}
ORACLES = {**_ORACLES}
