"""Market-data and procurement-risk analytics, expressed as Spark jobs."""
