"""Structured Streaming versions of ingest profiling and session summaries."""
