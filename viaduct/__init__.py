"""viaduct: corridor analytics as Spark DataFrame plans."""
