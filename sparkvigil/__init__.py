"""Evidence correlation on Spark."""
