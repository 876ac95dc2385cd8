"""nearkin: near-duplicate analytics on Spark DataFrames."""
