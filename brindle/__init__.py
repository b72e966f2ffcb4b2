"""brindle: a Spark-first engine for passages, retrieval, conversations and recordings."""
