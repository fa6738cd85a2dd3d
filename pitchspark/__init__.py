"""Football tracking data on Spark: canonical tables, features, quality checks and model windows."""
