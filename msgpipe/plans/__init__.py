"""Whole jobs: live batch, offline replay, capture."""
