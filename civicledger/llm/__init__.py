"""Operators for preparing language-model training data, one module each; nothing else in the library imports them."""
