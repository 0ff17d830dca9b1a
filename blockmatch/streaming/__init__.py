"""Lookups on streams."""
