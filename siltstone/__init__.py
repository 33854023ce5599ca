"""siltstone: a column-analytics engine expressed with Spark DataFrames and SQL."""

__version__ = "0.1.0"
