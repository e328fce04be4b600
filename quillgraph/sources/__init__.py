"""Graphs over tables, and snapshots."""
