"""lakequill: evaluation-data and corpus analytics expressed as Spark DataFrame plans."""
