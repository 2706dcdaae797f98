"""Code-intelligence analytics on Spark: graphs, change histories, retrieval, sessions."""
