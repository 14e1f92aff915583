"""Landed inputs: postings, profiles, pages, payloads."""
