"""Quarry plans."""
