"""Graphs that follow a stream of files."""
