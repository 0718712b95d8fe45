"""Session-log operators."""
