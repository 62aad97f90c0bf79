"""Training-data operators: each works on whole texts, with Spark doing the partitioning and the shuffles."""
