"""Scans, sinks and test views."""
