"""Bank call-report analytics as Spark DataFrame jobs."""
