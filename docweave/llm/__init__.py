"""Operators for text that goes into training data; nothing else in the library imports this."""
