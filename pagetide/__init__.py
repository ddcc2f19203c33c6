"""Document-traffic analytics and document-set operations as Spark DataFrame jobs."""
