"""Structured Streaming jobs: payload ingest, sliding-window risk, newest reading."""
