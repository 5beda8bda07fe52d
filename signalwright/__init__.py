"""Event-signal analytics on Spark."""
