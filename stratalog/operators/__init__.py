"""Operators over DataFrames of log lines."""
