"""Index, retrieval, ranking, vector and evaluation operators."""
