"""Relational, text and graph operators."""
