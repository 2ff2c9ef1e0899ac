"""Column expressions and numeric kernels on vectors."""
