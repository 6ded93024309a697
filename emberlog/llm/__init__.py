"""Operators that prepare text corpora for training: near duplicates, mixing, language, leaks, secrets, counts."""
