"""lodex: listing-index analytics and corpus preparation as Spark jobs."""
