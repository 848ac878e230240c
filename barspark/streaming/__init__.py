"""Structured Streaming forms of the rollups."""
