"""Corporate credit-distress analytics as Spark jobs."""
