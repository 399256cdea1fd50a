"""Streaming of the scripture-reference engine."""
