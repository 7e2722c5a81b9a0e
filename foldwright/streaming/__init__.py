"""Incremental forms of the statistics and the incumbent."""
