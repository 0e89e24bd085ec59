"""Relational operators over style occurrences."""
