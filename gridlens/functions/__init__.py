"""Categories of types, text forms, dates in text."""
