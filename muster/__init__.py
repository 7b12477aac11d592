"""Fleet-configuration analytics as Spark DataFrame operators."""
