"""The query registry: every operator bound to the driver tables, with its oracle text."""

from __future__ import annotations

from partsight.plans import registry
from partsight.plans import catalog, commerce, history, inventory, policy, profile, state, streams, text, traffic  # noqa: F401  (registration on import)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
