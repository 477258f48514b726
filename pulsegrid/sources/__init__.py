"""Scans over document collections and reference tables, and the metric registry."""
