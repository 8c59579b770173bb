"""Structured Streaming forms of the hourly aggregation and the restatement step."""
