"""Whole jobs: scoring a corpus, rolling it up, reporting on it."""
