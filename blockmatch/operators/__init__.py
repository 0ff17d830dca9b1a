"""Operators on block sets."""
