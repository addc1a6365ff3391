"""Evidence analytics over gridded Earth-observation tables, as Spark DataFrame operations."""
