"""Research operators over long-form price and event series, written as Spark jobs."""
