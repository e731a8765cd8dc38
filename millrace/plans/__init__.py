"""Iterative plans."""
