"""Stages of a query, and cutting the lineage of iterative plans."""
