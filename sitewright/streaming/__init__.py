"""Pages that arrive."""
