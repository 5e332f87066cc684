"""logloom.streaming."""
