"""Composed pipelines: hybrid retrieval, reranking and the answer loop."""
