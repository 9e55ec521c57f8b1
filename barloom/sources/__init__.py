"""Scans and sinks: bars, news, and keyed tables."""
