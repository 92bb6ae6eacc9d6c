"""airloom: analytics over daily environmental readings, as Spark jobs."""
