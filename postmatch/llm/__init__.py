"""Operators for preparing training text: ten on whole tables, and their queries."""
