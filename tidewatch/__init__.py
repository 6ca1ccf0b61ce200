"""tidewatch: data-pipeline observability as plain Spark DataFrame jobs."""
