"""The pipeline as Structured Streaming."""
