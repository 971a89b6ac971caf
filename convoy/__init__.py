"""Fleet-telemetry analytics written as PySpark DataFrame and Structured Streaming jobs."""
