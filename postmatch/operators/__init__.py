"""Matching operators over columns and tables."""
