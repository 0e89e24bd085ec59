"""Streams of source files."""
