"""Sessions, shipping of this package to executors, indexing, and query plans over tables."""
