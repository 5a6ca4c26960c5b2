"""Functions of the address engine."""
