"""Quarry functions."""
