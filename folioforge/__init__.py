"""Page-archive analytics on Spark: text to typed facts, reconciled with feeds, reported and served as DataFrames."""
