"""Operators for training data from texts and source files; nothing else in the library imports this package."""
