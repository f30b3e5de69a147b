"""Readers: driver tables, text formats and nested records."""
