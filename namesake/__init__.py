"""Author-name disambiguation and corpus preparation on Spark."""
