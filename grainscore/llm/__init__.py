"""Operators for training-data pipelines over documents, pages, vectors and conversations.

Nothing else in the package imports this subpackage.  Each operator takes a
frame and the names of the columns it reads, keeps nothing but those (so any
further columns, whatever their names, cannot clash) and returns the
identifier with its results.
"""
