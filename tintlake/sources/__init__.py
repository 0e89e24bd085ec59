"""Reading style sources."""
