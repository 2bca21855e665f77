"""Operators for large text-training data; nothing outside this folder imports them."""
