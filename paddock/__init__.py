"""Race-results preparation and boosted-tree analytics on Spark DataFrames."""
