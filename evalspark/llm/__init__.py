"""Operators for training corpora; nothing outside this subpackage imports it."""
