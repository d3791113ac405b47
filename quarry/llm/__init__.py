"""Operators for preparing large text corpora (deduplication, classifiers, mixing, packing)."""
