"""Target-anchored data curation as Spark DataFrame jobs."""
