"""Other notations that become the same step lists."""
