"""Graph analytics over code and documents, written as Spark DataFrame jobs."""
