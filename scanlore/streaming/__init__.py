"""Repeated ingest as a stream."""
