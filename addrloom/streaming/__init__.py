"""Streaming of the address engine."""
