"""Part of the analytics engine."""
