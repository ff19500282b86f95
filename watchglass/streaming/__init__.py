"""Structured Streaming forms of the detection and correlation operators."""
