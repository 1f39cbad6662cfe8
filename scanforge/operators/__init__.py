"""Relational operators on keyed, long tables."""
