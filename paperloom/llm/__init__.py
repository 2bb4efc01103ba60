"""Operators for text meant for language models. Nothing outside this subpackage imports it."""
