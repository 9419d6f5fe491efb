"""Relational operators over device readings."""
