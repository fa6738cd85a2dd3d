"""Registered queries, their SQL oracles, and the test-table projection both read."""
