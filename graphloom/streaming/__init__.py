"""Structured Streaming operators: ordered logs, sessions, late data."""
