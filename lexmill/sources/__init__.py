"""Corpus readers and the saved-table sink."""
