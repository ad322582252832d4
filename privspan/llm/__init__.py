"""Operators that prepare text and embedding tables for language-model training."""
