"""quarry: retrieval, code-intelligence and corpus analytics expressed in Spark."""
