"""Scalar functions: kernels, scaling, basis terms, closed-form moments."""
