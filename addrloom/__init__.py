"""Address resolution and data preparation on Spark."""
