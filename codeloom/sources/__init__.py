"""Directories of source files, git changes, and the store of graph snapshots."""
