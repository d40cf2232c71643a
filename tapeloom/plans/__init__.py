from .spec import QUERIES
from . import panel_queries, ledger_queries, sector_queries, bar_queries, board_queries, stream_queries, store_queries, history_queries, live_queries, session_queries  # noqa: F401

__all__ = ["QUERIES"]
