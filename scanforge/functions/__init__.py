"""Scalar expressions and numpy kernels."""
