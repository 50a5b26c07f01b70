"""Registered queries (Spark builders) and their SQL oracles."""
