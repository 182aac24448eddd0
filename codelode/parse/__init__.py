"""Source text to rows."""
