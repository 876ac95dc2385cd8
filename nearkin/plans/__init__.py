"""Whole queries over a library, and what they do to files."""
