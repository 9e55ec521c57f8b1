"""Scalar functions: money, text, statistics."""
