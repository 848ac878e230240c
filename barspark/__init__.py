"""barspark: price-bar analytics as Spark DataFrame transforms."""
