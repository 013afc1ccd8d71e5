"""Inputs, stores and generators."""
