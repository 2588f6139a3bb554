"""Structured Streaming forms of the row-wise and counting operators."""
