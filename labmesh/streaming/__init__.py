"""Structured Streaming monitors for freezers and data access."""
