"""Queries, oracles and governance."""
