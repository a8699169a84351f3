"""Rate-quality analytics as Spark DataFrame operators."""
