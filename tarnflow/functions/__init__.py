"""Columns: hashed randomness and special functions."""
