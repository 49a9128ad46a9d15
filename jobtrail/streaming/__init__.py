"""Incremental ingestion and aggregates by Structured Streaming."""
