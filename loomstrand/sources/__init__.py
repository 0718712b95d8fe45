"""Session-log sources."""
