"""Claims-document analytics on Spark."""
