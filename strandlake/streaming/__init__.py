"""Continuous classification."""
