"""The queries; importing any of them registers all."""

from quillgraph.plans import queries_change, queries_docs, queries_engine, queries_graph, queries_retrieval, queries_text  # noqa: F401
