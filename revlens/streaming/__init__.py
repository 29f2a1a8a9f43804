"""Structured Streaming entry points for the stateless row checks."""
