"""Scalar and table functions over text."""
