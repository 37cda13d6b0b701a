"""Structured Streaming forms of operators (an extension: the inventory has no streams)."""
