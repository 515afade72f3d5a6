"""Readers and writers of unit files."""
