"""Review feature mining as Spark DataFrame jobs."""
