"""Content-integrity analytics on Spark."""
