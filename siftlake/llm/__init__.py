"""Operators on training data: text, code and records. Nothing else in the library imports this."""
