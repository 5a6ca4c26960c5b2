"""Sources of the address engine."""
