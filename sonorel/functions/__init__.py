"""Column functions and numeric kernels used by the operators."""
