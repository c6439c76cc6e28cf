"""Every registered query: a Spark plan and, where SQL can say it, the oracle SQL.

The queries live in :mod:`smogcast.plans.queries`, one module per topic;
importing them here registers them, in order, into ``QUERIES`` / ``SQL``.
"""

from __future__ import annotations

from .queries.registry import QUERIES, SQL, finish, fresh_master, master, register  # noqa: F401
from .queries import tables, status, forecasting, metrics, training, streams, documents, stored  # noqa: F401,E402
from .queries.status import status_frame  # noqa: F401
from .queries.forecasting import prediction_frame  # noqa: F401
