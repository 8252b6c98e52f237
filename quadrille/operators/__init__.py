"""The operations on a graph."""
