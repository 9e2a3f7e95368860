"""Quarry streaming."""
