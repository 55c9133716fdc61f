"""All registered queries and the SQL that each is checked against."""

from scriptorium.plans import article_queries, corpus_queries, ledger_queries, retrieval_queries, stream_queries, text_queries, usage_queries, write_queries  # noqa: F401
from scriptorium.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
