"""Named queries over the given tables; importing this package registers all."""

from larkspur.queries.registry import ORACLES, QUERIES  # noqa: F401
from larkspur.queries import (  # noqa: F401
    aggregates,
    documents,
    enrichment,
    evaluation,
    governance,
    relational,
    retrieval,
    semantic,
    sources,
    streams,
    telemetry,
)
