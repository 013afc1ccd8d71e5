"""Whole fits and training loops over operators."""
