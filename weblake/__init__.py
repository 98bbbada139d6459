"""weblake: Spark jobs for web mining at scale."""
