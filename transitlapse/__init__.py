"""Cross-feed GTFS identity, diff and timeline analytics as PySpark DataFrame operators."""
