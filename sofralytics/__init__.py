"""Restaurant and dish review analytics as Spark DataFrame operators."""
