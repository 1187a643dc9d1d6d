"""Security-log analytics and text retrieval as Spark jobs."""
