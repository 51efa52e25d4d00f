"""Evidence analytics on Spark: literature text operators as DataFrame plans."""
