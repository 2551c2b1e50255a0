"""Incremental ingestion of generated sessions (Structured Streaming)."""
