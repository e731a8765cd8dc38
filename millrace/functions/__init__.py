"""Column functions."""

from millrace.functions.scalars import COMPARISONS, compare, decimal_format, fields, number, six_places, tokens, uniform_draw

__all__ = ["COMPARISONS", "compare", "decimal_format", "fields", "number", "six_places", "tokens", "uniform_draw"]
