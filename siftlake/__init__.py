"""siftlake: a Spark-first code and content analysis engine."""
