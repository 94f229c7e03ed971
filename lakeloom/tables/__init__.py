"""Table maintenance: expiry, reachability, compaction planning."""
