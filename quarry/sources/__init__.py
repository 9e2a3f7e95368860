"""Quarry sources."""
