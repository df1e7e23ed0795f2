"""Scalar functions, labels and fixed values."""
