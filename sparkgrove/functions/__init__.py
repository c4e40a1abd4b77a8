"""Scalar column functions and driver-side text helpers."""
