"""Readers of registry files and of serialized statements."""
