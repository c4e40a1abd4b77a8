"""Relational operators of the search engine."""
