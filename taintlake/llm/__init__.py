"""Operators for corpora of training text; see README, section "Training data"."""
