"""Phases, their dependencies and their freshness."""
