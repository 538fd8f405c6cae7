"""Log-triage analytics as Spark DataFrame and Structured Streaming jobs."""
