"""Queries and their SQL."""
