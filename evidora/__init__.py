"""Evidence retrieval and corpus processing on PySpark."""
