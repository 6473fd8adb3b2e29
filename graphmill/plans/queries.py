"""All queries over the driver's tables, except those of the corpus subpackage."""

from __future__ import annotations

from graphmill.plans import analytics, codegraph, context, graphs, memory, relational, retrieval, rules, service, structure, textual  # noqa: F401
from graphmill.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
