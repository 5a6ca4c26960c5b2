"""Operators of the address engine."""
