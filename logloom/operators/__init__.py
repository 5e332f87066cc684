"""logloom.operators."""
