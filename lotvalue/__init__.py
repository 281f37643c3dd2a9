"""Fair-market-value analytics for auction lots, expressed as Spark jobs."""
