"""From the text of a source file to symbols, imports, call sites and inheritance."""
