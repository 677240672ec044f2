"""Operators for preparing training text at scale.

Nothing outside this package imports it; the rest of the library works without it.
"""
