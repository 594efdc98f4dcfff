"""Imports every module that registers queries."""

from causegraph.plans import dialogue_queries, etl_queries, eval_queries, file_queries, function_queries, graph_queries, grounding_queries, index_queries, kg_queries, term_queries  # noqa: F401
