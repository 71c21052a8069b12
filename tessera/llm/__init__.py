"""Operators that prepare training data. Optional: nothing outside this folder imports it."""
