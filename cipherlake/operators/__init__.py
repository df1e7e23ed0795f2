"""Operators over findings and source lines."""
