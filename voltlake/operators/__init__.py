"""Operators: every function takes DataFrames and returns one; nothing is collected."""
