"""All registered queries, sorted by id."""

from __future__ import annotations

from meltemi.plans import sf_operators, sf_queries, sf_streams  # noqa: F401  (the modules register their queries)

REGISTRY = dict(sorted(sf_queries.REGISTRY.items()))
