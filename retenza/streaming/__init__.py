"""Structured Streaming drivers and sinks."""
