"""News-corpus sentiment and topic analytics as Spark DataFrame operators."""
