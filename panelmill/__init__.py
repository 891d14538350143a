"""Panel factor analytics on Spark."""
