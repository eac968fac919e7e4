"""All queries outside the optional subpackage."""

from __future__ import annotations

from keytide.plans import cluster, kv, problems, rules, stateful, streams
from keytide.plans.registry import Registry, Run

REGISTRY = Registry()
for _part in (problems.REGISTRY, kv.REGISTRY, stateful.REGISTRY, cluster.REGISTRY, rules.REGISTRY, streams.REGISTRY):
    REGISTRY.queries.update(_part.queries)
    REGISTRY.oracles.update(_part.oracles)


def queries() -> dict[str, Run]:
    """Queries by name."""
    return dict(REGISTRY.queries)


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that have it."""
    return dict(REGISTRY.oracles)
