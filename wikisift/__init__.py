"""Wiki page and dump extraction, indexing and ranked search as Spark jobs."""
