"""Operators for building training corpora from text: each module is one operator with its method in the docstring."""
