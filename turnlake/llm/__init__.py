"""Operators for preparing training text: cleaning, de-duplication, scoring, mixing, tokens, archives, search."""
