"""Sources of the scripture-reference engine."""
