"""talewright: conversation-history analytics in DataFrame and SQL operations."""
