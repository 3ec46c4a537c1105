"""Search-grid analytics as Spark DataFrame operators."""
