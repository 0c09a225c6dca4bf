"""Operators for large training corpora, each with a general interface and a registered query."""
