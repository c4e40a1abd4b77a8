"""Micro-batch refresh of stored indexes."""
