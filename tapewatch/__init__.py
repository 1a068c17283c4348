"""Trade-surveillance analytics on Spark."""
