"""Operators; importing this package registers their queries."""
