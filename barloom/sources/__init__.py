"""Readers of captures, registries, recorded sessions and in-memory series."""
