"""Institution-risk analytics on Spark."""
