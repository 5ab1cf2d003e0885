"""Operators over ordered bars: each takes a DataFrame and adds columns."""
