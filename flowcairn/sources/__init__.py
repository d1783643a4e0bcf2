"""Feeds in, results out."""
