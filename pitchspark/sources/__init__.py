"""Provider files to canonical tables.

Each provider has a reader, which only finds and loads files, and pure functions from raw to
canonical DataFrames.
"""
