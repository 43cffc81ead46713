"""Operators on streams that keep state."""
