"""Operators for preparing model-training text and vectors out of verdict rows, reviews and clip signals."""
