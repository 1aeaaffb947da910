"""Operators for large text corpora: one module each, and `queries` that applies them to whole tables."""
