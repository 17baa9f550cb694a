"""Point-in-time time-series research on Spark."""
