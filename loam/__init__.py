"""loam: a full-text analytics engine expressed as Spark DataFrame plans."""
