"""Tables of memories and their stores, and readers of files."""
