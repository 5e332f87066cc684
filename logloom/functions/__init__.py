"""logloom.functions."""
