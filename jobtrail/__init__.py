"""Job-history analytics on Spark."""
