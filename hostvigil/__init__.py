"""Fleet network-health analytics as Spark DataFrame operators."""
