"""Operators for text of language models; nothing outside this package imports it."""
