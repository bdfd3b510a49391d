"""spanlake: trace analytics as PySpark DataFrame and Structured Streaming operators."""
