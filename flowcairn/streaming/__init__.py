"""Streaming forms of ingestion, flow assembly and scoring."""
