"""Data-contract validation expressed as Spark DataFrame plans."""
