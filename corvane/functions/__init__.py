"""Types, literals and column functions."""
