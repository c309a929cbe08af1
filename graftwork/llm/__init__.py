"""Operators for training data: near duplicates, top-N, co-occurrence, tokenizing, packing and text repair."""
