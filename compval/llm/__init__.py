"""Operators that prepare training data: search, packing, deduplication, classifiers, tokens, media, chat."""
