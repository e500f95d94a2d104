"""Vector search and analysis on Spark: exact and graph-based nearest neighbours as DataFrame operators."""
