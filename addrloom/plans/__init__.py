"""Plans of the address engine."""
