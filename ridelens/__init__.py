"""ridelens: ride-telemetry analytics on Spark DataFrames and Structured Streaming."""

SCHEMA_VERSION = "1.0"
