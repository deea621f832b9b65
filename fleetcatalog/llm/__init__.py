"""Operators for training text: each module holds one; ``queries`` runs them on the given tables."""
