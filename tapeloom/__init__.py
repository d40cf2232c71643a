"""Market-panel and bar-stream analytics as Spark DataFrame operators."""
