"""Column expressions and sequential kernels."""
