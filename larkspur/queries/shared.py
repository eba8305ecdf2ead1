"""SQL fragments the oracles share, stated apart from the Spark code, and stored indexes."""

from __future__ import annotations

from collections.abc import Callable

from larkspur.session import work_dir
from larkspur.sources import storage

# one request per event, in the request-metrics contract
REQUESTS = """requests AS (
  SELECT 'req-' || event_id AS request_id, event_id, ts, user_id,
         CAST(round(value * 100) AS BIGINT) AS latency_ms,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS total_tokens,
         CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status,
         event_type AS topic,
         CAST(json_extract_string(props, '$.k') AS BIGINT) / 100.0 AS groundedness,
         CASE event_type WHEN 'error' THEN 'down' WHEN 'purchase' THEN 'up' END AS user_feedback
  FROM events)"""

# SQL for lower-cased letter/digit runs and whitespace words
TOKENS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"
WORDS = r"[w FOR w IN regexp_split_to_array({c}, '\s+') IF w <> '']"


def tokens(column: str) -> str:
    return TOKENS.format(c=column)


def words(column: str) -> str:
    return WORDS.format(c=column)


OTHER_TOPIC = "view"


_stored: dict[tuple, str] = {}  # folders of indexes by application, table and purpose


def stored_once(t, table: str, purpose: str, build: Callable[[str], object]) -> str:
    """The folder of what ``build`` writes from a table, written once while table and folder stay as they are."""
    path = t.path(table)
    key = (t.spark.sparkContext.applicationId, path, purpose, storage.changed(t.spark, path))
    if key not in _stored or not storage.exists(t.spark, _stored[key]):
        root = work_dir(t.spark, purpose)
        build(root)
        _stored[key] = root
    return _stored[key]
