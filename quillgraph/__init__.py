"""Retrieval over a corpus and the graph of facts in it, on Spark."""

from quillgraph.config import Config
from quillgraph.engine import DenseRag, GraphRag

__all__ = ["Config", "DenseRag", "GraphRag"]
