"""Operators for model-text corpora; nothing outside this package imports it."""
