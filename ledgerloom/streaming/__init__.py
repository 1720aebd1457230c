"""Change capture and continuously refreshed aggregates on Structured Streaming."""
