"""vialframe: laboratory-report analytics expressed as Spark DataFrame plans."""
