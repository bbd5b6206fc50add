"""Operators for building language-model training data: ten components and their queries."""
