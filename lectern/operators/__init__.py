"""Operators of the scripture-reference engine."""
