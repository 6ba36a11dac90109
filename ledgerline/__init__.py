"""Feature tables from prices, news and fundamentals, as Spark DataFrames."""
