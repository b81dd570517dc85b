"""Lodestrata: source-repository analytics expressed as Spark DataFrame plans."""
