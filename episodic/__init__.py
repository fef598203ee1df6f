"""Event analytics over tracked observations, as Spark plans."""
