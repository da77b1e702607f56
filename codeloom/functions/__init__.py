"""Names, kinds and languages, and column functions over text."""
