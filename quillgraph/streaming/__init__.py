"""Synchronising stores."""
