"""Incremental upkeep of the catalogue."""
