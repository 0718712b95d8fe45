"""Session-log plans."""
