"""Operators on texts: packing, mixing and language identification. Nothing outside this subpackage imports it."""
