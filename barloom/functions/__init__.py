"""Expressions over ordered bars, and the rolling statistics built from them."""
