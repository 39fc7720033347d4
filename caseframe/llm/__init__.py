"""Operators for text that is to become training data. Nothing outside this subpackage imports it."""
