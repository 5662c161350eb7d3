"""Operators for training data of language models. Nothing else in the library imports this package."""
