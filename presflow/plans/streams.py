"""Queries that run a stream over the tables' files to its end and read what it wrote."""

from __future__ import annotations

import uuid

from ..operators import intervals as I
from ..session import shared_folder
from ..sources.views import track_stream
from ..streaming import batches
from .intervals import _merge_sql
from .registering import registry

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)
_P, _LATE = I.MergeParams(), 100_000


# what starts up to the last watermark is settled; a person's last interval is given once nothing can join it
@query(
    f"""{_merge_sql(_P, f"start_ms <= (SELECT max(start_ms) FROM tracks) - {_LATE}")}, g AS (SELECT person, g, max_by(start_ms, n) AS start_ms, max_by(end_ms, n) AS end_ms, max_by(conf, n) AS conf, max_by(visible, n) AS visible,
  CAST(max_by(frames, n) AS BIGINT) AS frames, max_by(members, n) AS members, g = max(g) OVER (PARTITION BY person) AS open FROM state GROUP BY person, g)
 SELECT person, start_ms, end_ms, conf, visible, frames, members FROM g WHERE NOT open OR end_ms + {_P.reach} < (SELECT max(start_ms) FROM tracks) - {_LATE}"""
)
def stream_timeline(spark, sf_dir):
    return batches.merged(track_stream(spark, sf_dir), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", _P, late_ms=_LATE)
