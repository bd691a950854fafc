"""Operators over text corpora for preparing training data; nothing outside imports this package."""
