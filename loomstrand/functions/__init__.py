"""Session-log functions."""
