"""Session-log streaming."""
