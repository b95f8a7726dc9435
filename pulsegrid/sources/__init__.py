"""Readers of landed files and writers of contract tables."""
