"""Structured Streaming forms of the operators that see data piecemeal."""
