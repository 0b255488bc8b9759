"""Scans and sinks of the event lake."""
