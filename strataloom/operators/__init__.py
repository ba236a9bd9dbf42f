"""DataFrame operators: graph, ingestion, retrieval, grouping, ordinals."""
