"""Document-knowledge analytics as Spark DataFrame operators."""
