"""skyframe: station and grid time-series analytics as Spark DataFrame operators."""
