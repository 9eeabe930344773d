"""Query families over one open table."""
