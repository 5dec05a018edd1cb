"""sluice: message, log and task analytics expressed as Spark DataFrame plans."""
