"""Operators on texts and records of training corpora. Nothing outside this subpackage imports it."""
