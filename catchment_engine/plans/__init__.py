"""Whole checks made of operators: contracts, accounting, golden tables, mutation runs."""
