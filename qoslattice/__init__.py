"""Network-quality analytics on Spark."""
