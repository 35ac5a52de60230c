"""Change-feed analytics on Spark."""
