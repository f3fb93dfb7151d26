"""sagelode: hybrid retrieval and text analytics as Spark DataFrame plans."""
