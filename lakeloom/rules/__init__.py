"""Rule algebra: globs, conditions, policies, lifecycle, replication, notification."""
