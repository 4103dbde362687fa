"""Street-safety trajectory analytics on Spark."""
