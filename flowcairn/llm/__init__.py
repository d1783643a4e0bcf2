"""Operators for training-data pipelines at corpus scale. Nothing outside this package imports it."""
