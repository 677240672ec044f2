"""Readers that give log lines and groups."""
