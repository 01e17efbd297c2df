"""Language-model evaluation analytics expressed as Spark DataFrame jobs."""
