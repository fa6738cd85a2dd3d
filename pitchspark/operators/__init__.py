"""DataFrame operators over the canonical tracking table."""
