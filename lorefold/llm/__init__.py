"""Operators that prepare text for training corpora. Nothing outside this subpackage imports it."""
