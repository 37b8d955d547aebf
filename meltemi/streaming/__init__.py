"""Structured Streaming forms: ingest, latest state, buckets, alerts and dispatch."""
