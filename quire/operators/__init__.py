"""Operators over unit tables."""
