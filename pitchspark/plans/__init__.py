"""Whole computations: the feature table and the file-to-file jobs."""
