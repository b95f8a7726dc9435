"""pulsegrid: ordered-series analytics and corpus preparation as Spark jobs."""
