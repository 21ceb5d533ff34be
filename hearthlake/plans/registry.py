"""Every query of the listing engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from hearthlake.plans import detail_queries, file_queries, function_queries, listing_queries, scalar_queries, source_queries, store_queries, stream_queries

QUERIES: dict = {**listing_queries.QUERIES, **scalar_queries.QUERIES, **source_queries.QUERIES, **detail_queries.QUERIES, **store_queries.QUERIES, **stream_queries.QUERIES, **function_queries.QUERIES, **file_queries.QUERIES}
ORACLES: dict[str, str] = {**listing_queries.ORACLES, **scalar_queries.ORACLES, **source_queries.ORACLES, **detail_queries.ORACLES, **store_queries.ORACLES, **stream_queries.ORACLES, **function_queries.ORACLES, **file_queries.ORACLES}
