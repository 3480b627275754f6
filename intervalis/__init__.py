"""Spark-first analytics over time-segmented data: search, rollups, interval operators, streams."""
