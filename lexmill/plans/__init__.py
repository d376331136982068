"""Whole corpus builds and the registered queries."""
