"""Corpus sources, snapshots and stored indexes."""
