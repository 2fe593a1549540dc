"""Readers of tables and text files."""
