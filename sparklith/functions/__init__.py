"""Column-level operators: types, expressions, validity, hashing, and the registry of kernels."""
