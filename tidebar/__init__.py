"""Time-series features, forecast scoring and forecast accuracy as Spark jobs."""
