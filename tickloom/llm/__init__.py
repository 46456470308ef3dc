"""Operators for training data: percentiles, packing, mixing and sentences."""
