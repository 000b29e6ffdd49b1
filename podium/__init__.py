"""podium: ranked-benchmark analytics and corpus preparation on Spark."""
