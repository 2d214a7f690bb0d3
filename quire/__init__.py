"""A document engine on Spark."""
