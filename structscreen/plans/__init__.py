"""Plan-level helpers shared by all operators (skew, ordering, checkpoints)."""
