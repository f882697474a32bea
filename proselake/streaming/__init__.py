"""Streams of findings and of ordered values."""
