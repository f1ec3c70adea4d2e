"""Operators that prepare records and texts for model training. Nothing outside this package imports it."""
