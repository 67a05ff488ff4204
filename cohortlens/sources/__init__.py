"""Readers and writers for hospital tables, notes, id lists and results."""
