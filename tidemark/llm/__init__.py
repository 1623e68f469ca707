"""Operators over texts for training data."""
