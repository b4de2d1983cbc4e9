"""Whole runs: split, clean, train, predict, evaluate."""
