"""Readers: tables, file listings, text, API descriptions."""
