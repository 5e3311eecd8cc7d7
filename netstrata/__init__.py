"""Network-based stratification as Spark jobs."""
