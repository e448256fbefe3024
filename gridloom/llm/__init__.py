"""Operators for training data: percentiles, token ids, packing and splitting."""
