"""Structured Streaming forms of the operators, and time rules."""
