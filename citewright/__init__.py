"""Bibliography analytics and training-data preparation as Spark jobs."""
