"""Graph retrieval and analytics on Spark: property graphs, vectors, full text, states, pipelines."""
