"""Structured Streaming ingestion of fact records."""
