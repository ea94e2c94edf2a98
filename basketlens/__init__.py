"""Daily retail behaviour analytics, written as Spark DataFrame jobs."""
