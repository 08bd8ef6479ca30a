"""Relational operators of the feature engine."""
