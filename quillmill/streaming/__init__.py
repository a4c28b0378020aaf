"""Operators on unbounded tables."""
