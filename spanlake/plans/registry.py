"""All queries over the span views, by name, and the SQL that gives the same rows in another engine."""

from __future__ import annotations

from spanlake.plans import anomaly as _anomaly  # noqa: F401
from spanlake.plans import correlate as _correlate  # noqa: F401
from spanlake.plans import graph as _graph  # noqa: F401
from spanlake.plans import incidents as _incidents  # noqa: F401
from spanlake.plans import lifecycle as _lifecycle  # noqa: F401
from spanlake.plans import memory as _memory  # noqa: F401
from spanlake.plans import questions as _questions  # noqa: F401
from spanlake.plans import sampling as _sampling  # noqa: F401
from spanlake.plans import search as _search  # noqa: F401
from spanlake.plans import spans as _spans  # noqa: F401
from spanlake.plans import stored as _stored  # noqa: F401
from spanlake.plans.base import QUERIES, SQL  # noqa: F401
