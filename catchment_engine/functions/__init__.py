"""Column functions: scalars, statistics and geometry."""
