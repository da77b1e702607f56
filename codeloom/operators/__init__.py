"""Operators over source files, symbols and the graph that they form."""
