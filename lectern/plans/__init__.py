"""Plans of the scripture-reference engine."""
