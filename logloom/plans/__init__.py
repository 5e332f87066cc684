"""logloom.plans."""
