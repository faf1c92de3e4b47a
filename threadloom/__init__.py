"""Chat and media archive analytics on Spark."""
