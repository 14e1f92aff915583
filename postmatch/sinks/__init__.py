"""Scored tables and reports."""
