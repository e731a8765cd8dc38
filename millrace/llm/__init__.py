"""Operators of a training-data pipeline at corpus scale. Nothing outside this subpackage imports it."""
