"""Continuous monitoring on Structured Streaming."""
