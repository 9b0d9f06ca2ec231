"""Streams: ingestion and micro-batches."""
