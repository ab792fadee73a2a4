"""Relational operators on reads, units and blocks."""
