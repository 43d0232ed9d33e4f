"""Table registry, loading, writing and shared storage."""
