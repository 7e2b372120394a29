"""Scans, sinks and connectors."""
