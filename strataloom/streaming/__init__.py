"""Structured Streaming: resumable ingestion, event-time windows."""
