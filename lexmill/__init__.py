"""Spark jobs that turn labelled source code into training tables."""
