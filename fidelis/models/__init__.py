"""Models that are fitted by Spark aggregates under a driver loop."""
