"""Source-traced civic data analytics on Spark."""
