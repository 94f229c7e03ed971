"""Rolling and exponentially weighted statistics."""
