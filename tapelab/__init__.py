"""tapelab: market-tape analytics as PySpark DataFrame, SQL and Structured Streaming jobs."""
