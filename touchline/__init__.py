"""touchline: match analytics and corpus preparation as Spark jobs."""
