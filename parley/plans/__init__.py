"""The query catalogue: every operator over the test tables, with SQL to check it."""

from parley.plans import (  # noqa: F401  (each module registers its queries)
    conversations,
    dataset,
    ordered,
    scores,
    stored,
    streams,
    texts,
)
from parley.plans.registry import oracles, queries  # noqa: F401
