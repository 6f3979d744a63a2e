"""Mail archive, retrieval and data preparation on Spark."""
