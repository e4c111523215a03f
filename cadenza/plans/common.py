"""Plan helpers: a registry for one module, and the fixture views in SQL."""

from __future__ import annotations

from collections.abc import Callable


class Plans:
    """Queries of one module, with SQL where SQL can express them."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn: Callable) -> Callable:
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = sql
            return fn

        return keep


#: The event tables as drum hits and as states, identical to the DataFrame adapters in ``schemas``.
HITS = """h0 AS (SELECT event_id, user_id AS track_id, event_type AS type, epoch_us(ts) - 1704067200000000 AS us, value AS velocity,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence FROM events),
h AS (SELECT *, us / 1e6 AS time FROM h0)"""
STATES = HITS + """,
s AS (SELECT event_id, track_id, time, track_id % 8 AS mode_index, velocity AS amplitude, 2 * pi() * confidence AS phase, 40.0 + track_id AS frequency,
  CAST(confidence * 100 AS BIGINT) AS k FROM h)"""


def hits(body: str) -> str:
    """A query over view ``h``; a body that begins with a comma adds views."""
    return f"WITH {HITS}{'' if body.startswith(',') else chr(10)}{body}"


def states(body: str) -> str:
    """A query over views ``h`` and ``s``."""
    return f"WITH {STATES}{'' if body.startswith(',') else chr(10)}{body}"
