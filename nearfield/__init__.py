"""Vector search as DataFrame operations on Spark."""
