"""lodestar: hybrid search and retrieval analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
