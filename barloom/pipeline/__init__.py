"""Operators that repair and reshape raw captures before features are computed."""
