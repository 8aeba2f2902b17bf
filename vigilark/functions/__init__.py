"""Column builders and numeric kernels."""
