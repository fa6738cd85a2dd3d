"""Column functions: casts, coordinate arithmetic and label handling."""
