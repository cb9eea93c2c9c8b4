"""Byte-level functions and column expressions."""
