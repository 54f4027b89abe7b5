"""Typed tables, row-group statistics and pruning, encodings, indexes and integrity on PySpark."""
