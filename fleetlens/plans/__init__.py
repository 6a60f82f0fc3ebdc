"""Queries over the stand-in tables, and their SQL."""
