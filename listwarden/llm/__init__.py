"""Operators for preparing text corpora for training; nothing else in the package imports them."""
