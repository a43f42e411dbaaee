"""Operators that prepare training data: one module for each, all independent of the page engine."""
