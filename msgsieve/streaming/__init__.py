"""Structured Streaming jobs: scoring, keyed state, retries and dead letters."""
