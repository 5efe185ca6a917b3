"""Incremental and rate-limited work."""
