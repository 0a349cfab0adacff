"""Whole products put together from the operators."""
