"""Stateful streaming extractors."""
