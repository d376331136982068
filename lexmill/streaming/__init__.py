"""Corpus builds over arriving files."""
