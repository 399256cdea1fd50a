"""Functions of the scripture-reference engine."""
