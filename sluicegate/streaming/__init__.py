"""Continuous verification: exact per micro-batch, or keyed state per lane."""
