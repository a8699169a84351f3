"""Operators for building training data from a corpus: one module per operator."""
