"""Event analytics on Spark: batch tables and Structured Streaming, DataFrame in, DataFrame out."""

__version__ = "0.1.0"
