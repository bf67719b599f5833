"""Shop audit and lead analytics as Spark jobs."""
