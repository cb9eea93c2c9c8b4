"""Incremental dedup of streams."""
