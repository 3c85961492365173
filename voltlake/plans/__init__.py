"""Queries over the supplied tables, each with its SQL where SQL can say the same."""
