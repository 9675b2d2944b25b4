"""Incremental ingest and resumable backfills."""
