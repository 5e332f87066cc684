"""logloom.sources."""
