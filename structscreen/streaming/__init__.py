"""User functions with fault handling, and incremental runs."""
