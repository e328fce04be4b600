"""Traversals, paths, adjacency, the journal and merges."""
