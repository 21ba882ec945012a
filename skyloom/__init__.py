"""Sky-survey analytics on Spark."""
