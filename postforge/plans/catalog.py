"""All queries of the engine and their SQL."""

from __future__ import annotations

from postforge.plans import board_queries, extra_queries, page_queries, poll_queries, queries, search_queries

#: Importing the modules registers their queries.
MODULES = (queries, board_queries, page_queries, extra_queries, poll_queries, search_queries)
QUERIES, ORACLES, FLAGSHIP = queries.QUERIES, queries.ORACLES, queries.ranked_feed_page
