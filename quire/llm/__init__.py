"""Operators for text that feeds language-model training."""
